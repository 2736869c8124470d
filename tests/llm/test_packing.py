import random
from collections import defaultdict

import pytest
from cases import ODD, make_docs  # noqa: F401
from pyspark.sql import functions as F

from taskloom.llm import packing


def brute_pack(lengths, capacities, overhead):
    """The rule as it is written, with lists scanned from end to end."""
    sizes, bins, placed = sorted(capacities), [], []
    for i, n in enumerate(lengths):
        rest = sorted(lengths[i + 1 :], reverse=True)
        fitting = [(b[0] - sum(b[1]), k) for k, b in enumerate(bins) if b[0] - sum(b[1]) >= n]
        if fitting:
            k = min(fitting)[1]
        else:
            best = None
            for c in sizes:
                if c < n:
                    continue
                room, held = c - n, n
                for m in rest:
                    if m <= room:
                        room, held = room - m, held + m
                if best is None or (c + overhead) / held < best[0]:
                    best = ((c + overhead) / held, c)
            k = len(bins)
            bins.append((best[1], []))
        placed.append((k, sum(bins[k][1])))
        bins[k][1].append(n)
    final = [min(c for c in sizes if c >= sum(held)) for _, held in bins]
    return [(k, at, final[k]) for k, at in placed]


@pytest.mark.parametrize("seed", range(12))
def test_pack_against_the_rule(seed):
    rng = random.Random(seed)
    top = rng.choice((16, 64, 300))
    lengths = sorted((rng.randrange(1, top + 1) for _ in range(rng.randrange(120))), reverse=True)
    capacities = sorted({top, *(rng.randrange(1, top + 1) for _ in range(3))})
    bins, at, final = packing.pack(lengths, capacities, 3)
    assert list(zip(bins.tolist(), at.tolist(), final.tolist())) == brute_pack(lengths, capacities, 3)


def whole(rows, capacities):
    """Sequences hold their pieces side by side, and are as small as they can be."""
    by_bin = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_length for r in pieces} == {min(c for c in capacities if c >= at)}


def test_odd_documents_lose_nothing(make_docs):  # noqa: F811
    capacities = (8, 32, 100)
    rows = packing.packed(make_docs(ODD), F.length("text"), capacities, 2, shard=5).collect()
    whole(rows, capacities)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.copy, r.length if r.piece else 0].append(r)
    total = sum(len(t or "") for _, t in ODD)
    assert sum(r.length for r in rows) == total
    empty = [r for r in rows if r.bin_id is None]
    assert len(empty) == sum(not t for _, t in ODD) and all(r.length == 0 for r in empty)
    long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.piece)
    assert [r.start for r in long] == list(range(0, len(dict(ODD)[7]), 100))
    assert sorted(r.copy for r in rows if r.doc_id == 4) == [1, 2]


def test_many_copies_of_one_row_are_told_apart(make_docs):  # noqa: F811
    rows = packing.packed(make_docs([(1, "abc")] * 50), F.length("text"), (10, 30), 1, shard=16).collect()
    whole(rows, (10, 30))
    assert sorted(r.copy for r in rows) == list(range(1, 51))


def test_one_shard_equals_the_rule(make_docs):  # noqa: F811
    rng = random.Random(1)
    docs = [(i, "x" * rng.randrange(1, 60)) for i in range(80)]
    rows = packing.packed(make_docs(docs), F.length("text"), (20, 40, 64), 4).collect()
    ordered = sorted(rows, key=lambda r: (-r.length, r.doc_id))
    assert [(int(r.bin_id.split("-")[1]), r.bin_offset, r.bin_length) for r in ordered] == brute_pack([r.length for r in ordered], (20, 40, 64), 4)


def test_several_lengths_cost_less_than_one(make_docs):  # noqa: F811
    rng = random.Random(2)
    lengths = sorted((min(1000, int(rng.paretovariate(0.8) * 20)) for _ in range(800)), reverse=True)
    used = lambda caps: sum({b: c for b, c in zip(*[x.tolist() for x in packing.pack(lengths, caps, 8)[::2]])}.values())
    assert sum(lengths) <= used((128, 256, 512, 1024)) <= used((1024,))


def test_empty_table_and_parameters(make_docs):  # noqa: F811
    assert packing.packed(make_docs([]), F.length("text")).count() == 0
    with pytest.raises(ValueError):
        packing.packed(make_docs([]), F.length("text"), ())


def test_pieces_beside_their_texts(make_docs):  # noqa: F811
    docs = make_docs([(1, "abcdef"), (2, "xy")])
    rows = packing.pieces_with_text(docs, packing.packed(docs, F.length("text"), (4,))).collect()
    assert sorted(r.text[r.start : r.start + r.length] for r in rows) == ["abcd", "ef", "xy"]
