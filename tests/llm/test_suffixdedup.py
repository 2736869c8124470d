"""Repeated byte strings against a count of every string."""

import random
from collections import Counter

import pytest
from cases import DOCS, ODD, make_docs  # noqa: F401

from taskloom.llm import suffixdedup


def brute(texts, length):
    """(number of bytes, removed runs, what is left) of every text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(d) + 1) if (i < len(d) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((len(d), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(docs, rows, **options):
    found = suffixdedup.without_repeats(docs, **options).collect()
    got = Counter((r.doc_id, r.n_bytes, tuple((s.low, s.high) for s in r.spans), bytes(r.kept)) for r in found)
    want = brute([r[1] for r in rows], options.get("length", suffixdedup.LENGTH))
    assert got == Counter((r[0], n, tuple(runs), kept) for r, (n, runs, kept) in zip(rows, want))


def passages(rng, n):
    """Texts of few letters that share passages, with edits, in front, in the middle and at the end."""
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(50, 700))) for _ in range(6)]
    for _ in range(n):
        text = "".join(rng.choices("abcdefgh ü", k=rng.randint(0, 400)))
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            low = rng.randint(0, 40)
            piece = piece[low : len(piece) - rng.randint(0, 40)]
            if rng.random() < 0.5 and piece:
                at = rng.randrange(len(piece))
                piece = piece[:at] + "#" + piece[at + 1 :]
            text += piece + "".join(rng.choices("xyz", k=rng.randint(0, 60)))
        yield text


@pytest.mark.parametrize("length, gram", [(200, 64), (64, 20), (40, 40)])
def test_shared_passages(make_docs, length, gram):  # noqa: F811
    rng = random.Random(length)
    rows = list(enumerate(passages(rng, 80)))
    rows += [(i + 1000, t) for i, t in rows[::7]] + rows[:3]  # copies, and rows that repeat
    rows += [(2000, "a" * 900), (2001, "ab" * 300), (2002, "b" + "ab" * 150), (2003, "a" * (length - 1)), (2004, None)]
    check(make_docs(rows), rows, length=length, gram=gram)


def test_many_surroundings_of_one_passage(make_docs):  # noqa: F811
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefghij", k=260))
    rows = [(i, "".join(rng.choices("klmnop", k=rng.randint(0, 90))) + passage + "".join(rng.choices("qrstu", k=rng.randint(0, 90)))) for i in range(120)]
    check(make_docs(rows), rows)


def test_odd_documents(make_docs):  # noqa: F811
    rows = [r for r in ODD if r[0] != 7] + [(7, "lorem ipsum dolor sit amet " * 300)]
    check(make_docs(rows), rows)


def test_slices_do_not_show(make_docs, monkeypatch):  # noqa: F811
    rng = random.Random(9)
    texts = list(passages(rng, 30))
    data = [t.encode() for t in texts]
    import numpy as np

    ends = np.cumsum([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    kmer, _, first, count, offset = suffixdedup.anchors(flat, ends - [len(d) for d in data], ends, 200, 64)
    windows = sum(max(0, len(d) - 199) for d in data)
    assert count.sum() == windows  # every window has one anchor
    assert (offset <= 136).all() and (offset >= count - 1).all()


def test_empty_table(spark):
    assert suffixdedup.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_short_anchor_is_refused(make_docs):  # noqa: F811
    with pytest.raises(ValueError):
        suffixdedup.without_repeats(make_docs([(1, "x")]), gram=8)
