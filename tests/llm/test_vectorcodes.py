"""Codes against Lloyd's algorithm in plain integers."""

import hashlib
import math
import random

import pytest

from taskloom.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, entry string, n string, tag int, part int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(256 * x) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    first = {}
    for r, v, c in sorted(zip(kept, whole, cut), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1])):
        first.setdefault(r[0], c)
    books = [[list(c[p]) for c in list(first.values())[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for c in cut:
                members[nearest(c[p], book)[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else e for m, e in zip(members, book)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "e", "n", 1, 2) for r in rows], SCHEMA)


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vectors(rng, n, size=32):
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(9)]
    return [(i * 3 % (2 * n), [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


def single(rows):
    """Components as the column holds them."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_equals_plain_integers(spark):
    rng = random.Random(1)
    rows = vectors(rng, 300)
    rows += rows[5:9] + [rows[0]] * 5  # equal rows
    rows += [(1, [0.5] * 32, 1), (1, [-0.25] * 32, None), (None, [0.125] * 32, 2), (None, [0.125] * 32, 2)]
    rows += [(7000, None, 1), (7001, [None] + [0.0] * 31, 1), (7002, [math.nan] * 32, 1), (7003, [math.inf] + [0.0] * 31, 1), (-5, [-0.0] * 32, 0)]
    rows = single(rows)
    assert got(vectorcodes.codes(frame(spark, rows))) == brute(rows)


def test_one_vector_under_many_ids(spark):
    """Members of one entry are spread by salt, and entries without members stay."""
    rows = single([(i, [0.25] * 16, 0) for i in range(400)] + [(1000 + i, [i / 64.0] * 16, 1) for i in range(80)])
    assert got(vectorcodes.codes(frame(spark, rows))) == brute(rows)


def test_fewer_rows_than_entries(spark):
    rows = single([(i, [float(i % 2)] * 16, None) for i in range(5)])
    assert got(vectorcodes.codes(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_other_numbers_of_rounds(spark, rounds):
    rows = single(vectors(random.Random(rounds), 120))
    found, books = vectorcodes.compressed(frame(spark, rows), entries=10, rounds=rounds)
    want = brute(rows, entries=10, rounds=rounds)
    assert vectorcodes.codebook_digest(books) == want[0][-1]
    assert sorted((r.vec_id, r.error) for r in found.collect()) == sorted((w[1], w[3]) for w in want)


def test_only_leaving_members_are_shuffled(spark, monkeypatch):
    sizes = {}
    plain = vectorcodes.staged

    def counted(df, label):
        out = plain(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(vectorcodes, "staged", counted)
    rows = single(vectors(random.Random(4), 300))
    vectorcodes.compressed(frame(spark, rows))
    assert sizes["vector-members"] == 16 * 300
    assert 0 < sizes["vector-arrivals"] < 16 * 300 / 2


def test_empty_and_unsound_tables(spark):
    assert vectorcodes.codes(frame(spark, [])).collect() == []
    assert vectorcodes.codes(frame(spark, [(1, None, None)])).collect() == []
    with pytest.raises(ValueError):
        vectorcodes.codes(frame(spark, [(1, [0.5] * 15, 1)]))
