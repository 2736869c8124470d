import hashlib
import random

import numpy as np
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import syncmers


def brute_syncmers(text, k, s):
    codes = [ord(c) + 1 for c in text]

    def poly(part):
        h = 0
        for c in part:
            h = (h * syncmers._BASE + c) % (1 << 64)
        return h

    def mixed(h):
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return h ^ (h >> 29)

    out = []
    for i in range(len(codes) - k + 1):
        inner = [mixed(poly(codes[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((mixed(poly(codes[i : i + k])), i))
    return out


def test_closed_syncmers_by_definition():
    rng = random.Random(2)
    for n, letters in ((20, "ab"), (21, "abcdefgh"), (400, "ab"), (400, "abcdefghij é東😀")):
        text = "".join(rng.choice(letters) for _ in range(n))
        hashes, at = syncmers.closed_syncmers(text)
        assert list(zip(hashes.tolist(), at.tolist())) == brute_syncmers(text, syncmers.K, syncmers.S)


def test_anchors_do_not_depend_on_context():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    own = set(syncmers.closed_syncmers(passage)[0].tolist())
    for before, after in (("", "tail of another text"), ("some head ", ""), ("x" * 50, "y" * 50)):
        assert own <= set(syncmers.closed_syncmers(before + passage + after)[0].tolist())


def test_sketch_takes_the_least_anchors():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    first = {}
    for h, i in brute_syncmers(text, syncmers.K, syncmers.S):
        first.setdefault(h >> 32, i)
    least = sorted(first)[: syncmers.ANCHORS]
    keys, at = syncmers.sketch(text)
    assert keys.tolist() == least and at.tolist() == [first[k] for k in least]
    assert [x.tolist() for x in syncmers.unpacked(syncmers.packed(keys, at))] == [keys.tolist(), at.tolist()]


def test_likeness():
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(9000)) for _ in range(2))
    sketches = [syncmers.sketch(t) for t in (a, b, a[:6000] + b[:3000], "", "short")]
    assert syncmers.likeness(sketches[0], sketches[0]) == 1 and syncmers.likeness(sketches[3], sketches[3]) == 1
    assert syncmers.likeness(sketches[4], sketches[4]) == 1 and syncmers.likeness(sketches[0], sketches[3]) == 0
    assert syncmers.likeness(sketches[0], sketches[1]) < 0.05
    assert 0.35 < syncmers.likeness(sketches[0], sketches[2]) < 0.65  # 2/3 kept: Jaccard 1/2
    reordered = syncmers.sketch(a[4500:] + a[:4500])
    assert syncmers.likeness(sketches[0], reordered) < 0.7  # the same anchors, half of them out of order


def expected_rows(docs):
    rows = [(-(1 << 63) if d is None else d, t or "") for d, t in docs]
    ids = sorted({d for d, _ in rows}, reverse=True)
    follower = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}
    text = {d: min(t for e, t in rows if e == d) for d in ids}
    out = []
    for d, t in rows:
        nxt, cut = text[follower[d]], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut] if cut else t
        own, other = syncmers.sketch(t), syncmers.sketch(edited)
        near = syncmers.likeness(own, other), syncmers.likeness(own, syncmers.sketch(nxt))
        out.append((None if d == -(1 << 63) else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.packed(*own), syncmers.packed(*other), *near))
    return sorted(out, key=str)


def test_edited_texts_of_odd_documents(make_docs):
    docs = [(d, t) for d, t in ODD]
    found = syncmers.edited_likeness(make_docs(docs))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_rows(docs)


def test_edited_texts_over_many_ranges(make_docs):
    rng = random.Random(7)
    docs = [(rng.randrange(10**6), "".join(rng.choice("abc d") for _ in range(rng.randrange(80)))) for _ in range(300)]
    found = syncmers.edited_likeness(make_docs(docs).repartition(7))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_rows(docs)


def test_one_document_and_none(make_docs):
    assert [tuple(r) for r in syncmers.edited_likeness(make_docs([(9, "alone in the world, and long enough")])).collect()] == expected_rows(
        [(9, "alone in the world, and long enough")]
    )
    assert syncmers.edited_likeness(make_docs([])).count() == 0


def test_fingerprints_of_every_row(make_docs):
    rows = syncmers.fingerprints(make_docs(ODD)).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=str) == sorted(((d, syncmers.packed(*syncmers.sketch(t))) for d, t in ODD), key=str)
    assert np.array_equal(syncmers.sketch(None)[0], syncmers.sketch("")[0])
