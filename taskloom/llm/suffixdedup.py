"""Repeated byte strings by distributed prefix doubling.

A byte goes if a string of `length` bytes covers it that also starts elsewhere. Prefix doubling ranks positions by longer and longer
strings; a position whose string is unique is done, one that still shares its string at the full length is repeated. Ranks are
fingerprints here, so that the rank at an offset is taken where the bytes are, and Spark sorts and groups what is still undecided:

1. Every window of `length` bytes has one anchor, the k-gram of least hash in it. Anchors are ranked by their k-gram; equal windows have
   equal anchors at equal offsets, so the windows of a unique anchor are unique. One position in some sixty enters this round.
2. Windows in a row with one anchor are one row. Rows whose whole surroundings (first to last byte of these windows) are equal
   are repeated as a whole, and one of them stands for all from here on: copies cost one row.
3. What still differs is split into blocks of 16, 4 and 1 windows at equal offsets to the anchor, ranked by the pair of the anchor's rank and
   the string that all windows of the block share; it grows to 185, 197 and 200 bytes. A unique one is done, a block whose union is equal in
   all its rows is repeated, and only mixed blocks are split further.

All rounds are aggregates and joins on fingerprints; work follows the number of anchors, not of bytes. Fingerprints have 64 bits at each
round and are only compared below the anchor's own 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import flat_bytes
from .common import arrow_batches, staged
from .syncmers import _mixed, _sliding_min, _window_hashes

LENGTH = 200
#: Bytes of an anchor. Shorter ones are less selective, longer ones are denser.
GRAM = 64
#: Windows in a block, from round to round.
BLOCKS = (16, 4, 1)
#: Windows hashed at a time.
SLICE = 1 << 18
#: A place is (first window, number of windows, offset of the anchor) in one long.
_BITS = 12
_LOW = (1 << 24) - 1

ANCHORS = "kmer long, near long, text long, place long"


def anchors(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash of the k-gram, hash of the surroundings, first window, windows, offset of the anchor) of every anchor of some texts that
    lie one after the other. Of equal k-grams in a window the first is the anchor."""
    hashed, whole = _window_hashes(flat.astype(np.uint64) + np.uint64(1), (gram, length))
    hashed = _mixed(hashed)
    keys = (hashed & ~np.uint64(_LOW)) | np.arange(len(hashed), dtype=np.uint64)
    at = (_sliding_min(keys, length - gram + 1) & np.uint64(_LOW)).astype(np.int64)
    inside = np.zeros(len(flat) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at[np.cumsum(inside[: len(at)]) == 0] = -1  # windows that cross texts
    first = np.flatnonzero(np.diff(at, prepend=-2))
    count = np.diff(np.append(first, len(at)))
    real = at[first] >= 0
    first, count = first[real], count[real]
    offset = at[first] - first
    shape = (offset * (1 << _BITS) + count).astype(np.uint64)
    near = _mixed(_mixed(whole[first] + shape) * np.uint64(3) + whole[first + count - 1])
    return hashed[first + offset], near, first, count, offset


def _anchor_rows(length: int, gram: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            flat, starts, ends = flat_bytes(batch.column("body"))
            texts = batch.column("text").to_numpy(zero_copy_only=False)
            for low in range(0, max(len(flat) - length + 1, 0), SLICE):
                high = min(len(flat), low + SLICE + length - 1)
                some = (ends > low) & (starts < high)
                begins = starts[some]
                found = anchors(flat[low:high], np.maximum(begins, low) - low, np.minimum(ends[some], high) - low, length, gram)
                kmer, near, first, count, offset = found
                own = np.searchsorted(begins, first + low, "right") - 1
                place = ((first + low - begins[own]) << (2 * _BITS)) | (count << _BITS) | offset
                columns = [kmer.view(np.int64), near.view(np.int64), texts[some][own], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kmer", "near", "text", "place"])

    return batches


def _first(place: str = "place") -> F.Column:
    return F.shiftright(place, 2 * _BITS)


def _count(place: str = "place") -> F.Column:
    return F.shiftright(place, _BITS).bitwiseAND((1 << _BITS) - 1)


def _offset(place: str = "place") -> F.Column:
    return F.col(place).bitwiseAND((1 << _BITS) - 1)


def _cut_pieces(length: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("kmer", pa.int64()), ("near", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("piece", pa.binary())])
        for batch in rows:
            out: list[tuple] = []
            for body, wanted in zip(batch.column("body").to_pylist(), batch.column("wanted").to_pylist()):
                data = body.encode("utf-8", "surrogatepass")
                for w in wanted:
                    low, count = w["place"] >> (2 * _BITS), (w["place"] >> _BITS) & ((1 << _BITS) - 1)
                    out.append((w["kmer"], w["near"], w["n"], w["place"], data[low : low + count - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds.types)], schema=kinds)

    return batches


def _block_rows(length: int, size: int):
    """Rows (kmer, near, n, block, inner, outer) of the wanted blocks of every piece; null means all of them."""
    kinds = pa.schema([("kmer", pa.int64()), ("near", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("inner", pa.int64()), ("outer", pa.int64())])
    mask, digest = (1 << _BITS) - 1, xxhash.xxh3_64_intdigest

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("kmer", "near", "n", "place", "piece", "parents", "parent_size"))
            for kmer, near, n, place, piece, parents, parent_size in zip(*columns):
                top = place & mask  # offset of the anchor in the first window; it falls by one from window to window
                bottom = top - ((place >> _BITS) & mask) + 1
                if parents is None:
                    blocks: Iterator[int] | range = range(bottom // size, top // size + 1)
                else:
                    each = parent_size // size
                    blocks = (b for p in parents for b in range(p * each, p * each + each) if b * size <= top and b * size + size > bottom)
                for b in blocks:
                    near_end, far_end = b * size, b * size + size - 1
                    low, high = max(bottom, near_end), min(top, far_end)
                    inner = digest(piece[top - near_end : top - far_end + length])
                    outer = digest(piece[top - high : top - low + length], seed=(high - near_end) * size + low - near_end)
                    out.append((kmer, near, n, b, signed(inner), signed(outer)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    return batches


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans."""
    runs: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    return [(a, b) for a, b in runs]


def _kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
    for batch in rows:
        out: list[tuple] = []
        for doc_id, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "spans"))):
            data = body.encode("utf-8", "surrogatepass")
            runs = _merged(spans or [])
            edges = [0, *(e for run in runs for e in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc_id, len(data), [{"low": a, "high": b} for a, b in runs], kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds.types)], schema=kinds)


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _rounds(open_rows: DataFrame, length: int) -> DataFrame | None:
    """(kmer, near, low, high): offsets of the repeated windows of the pieces (kmer, near, n, place, piece), round by round."""
    pieces = open_rows.withColumns({"parents": F.lit(None).cast("array<int>"), "parent_size": F.lit(0)})
    found: DataFrame | None = None
    key = ["kmer", "block", "inner"]
    for size in BLOCKS:
        rows = staged(pieces.mapInArrow(_block_rows(length, size), "kmer long, near long, n long, block int, inner long, outer long"), "repeat-blocks")
        groups = rows.groupBy(*key).agg(F.sum("n").alias("total"), F.min("outer").alias("least"), F.max("outer").alias("most"))
        alive = groups.where("total > 1").select(*key, (F.col("least") == F.col("most")).alias("alike"))
        judged = staged(rows.join(alive, key).select("kmer", "near", "block", "alike"), "repeat-judged")
        whole = judged.where("alike").select("kmer", "near", (F.col("block") * size).alias("low"), (F.col("block") * size + size - 1).alias("high"))
        found = whole if found is None else found.unionByName(whole)
        mixed = judged.where("NOT alike").groupBy("kmer", "near").agg(F.collect_list("block").alias("parents"))
        pieces = open_rows.join(mixed, ["kmer", "near"]).withColumn("parent_size", F.lit(size))
    return found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """text (64-bit hash of a text), spans: where bytes of a text are covered by a string of `length` bytes that also starts elsewhere.

    The spans of a text may overlap. Texts without any are left out; equal texts are one row.
    """
    if not BLOCKS[0] < gram <= length < 1 << _BITS:
        raise ValueError("the anchor must be longer than a block and no longer than the string, the string shorter than 4,096 bytes")
    spark = docs.sparkSession
    arrow_batches(spark)
    bodies = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).select(F.xxhash64("body").alias("text"), "body")
    ranked = bodies.where(F.octet_length("body") >= length).mapInArrow(_anchor_rows(length, gram), ANCHORS)

    # Round 1: k-grams that occur more than once. Round 2: equal surroundings become one row.
    shared = staged(ranked.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kmer"), "repeat-kmers")
    live = ranked.join(shared, "kmer", "left_semi").groupBy("kmer", "near", "text", "place").agg(F.count(F.lit(1)).alias("n"))
    live = staged(live, "repeat-anchors")
    one = F.min(F.struct("text", "place")).alias("one")
    nears = staged(live.groupBy("kmer", "near").agg(F.sum("n").alias("n"), one).select("kmer", "near", "n", "one.text", "one.place"), "repeat-nears")

    # Round 3 onwards: what shares a k-gram with other surroundings, on bytes cut out of the texts once.
    differing = nears.groupBy("kmer").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("kmer")
    wanted = nears.join(differing, "kmer", "left_semi").groupBy("text").agg(F.collect_list(F.struct("kmer", "near", "n", "place")).alias("wanted"))
    cut = bodies.join(wanted, "text").mapInArrow(_cut_pieces(length), "kmer long, near long, n long, place long, piece binary")
    pieces = staged(cut.groupBy("kmer", "near").agg(F.first(F.struct("n", "place", "piece")).alias("p")).select("kmer", "near", "p.*"), "repeat-pieces")
    blocks = _rounds(pieces, length)

    # From offsets to bytes: an anchor at a, a window at offset o starts at a - o.
    whole = nears.where("n > 1").select("kmer", "near", F.lit(None).cast("array<struct<low:int,high:int>>").alias("parts"))
    single = blocks.join(nears.where("n = 1").select("kmer", "near"), ["kmer", "near"], "left_semi")
    parts = single.groupBy("kmer", "near").agg(F.collect_list(F.struct("low", "high")).alias("parts"))
    judged = live.select("kmer", "near", "text", "place").join(whole.unionByName(parts), ["kmer", "near"])
    top, bottom = _offset(), _offset() - _count() + 1
    every = F.array(F.struct(bottom.cast("int").alias("low"), top.cast("int").alias("high")))
    inside = F.transform(F.coalesce("parts", every), lambda p: F.struct(F.greatest(p["low"], bottom).alias("low"), F.least(p["high"], top).alias("high")))
    anchor = _first() + _offset()
    spans = judged.select("text", F.explode(inside).alias("o"), anchor.alias("at"))
    spans = spans.select("text", F.struct((F.col("at") - F.col("o.high")).alias("low"), (F.col("at") - F.col("o.low") + length).alias("high")).alias("span"))
    return spans.groupBy("text").agg(F.collect_list("span").alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, half open, in order), kept (the bytes that remain), of every row.

    A string counts as repeated if it starts at two places of the table, in one text or in two; repeated rows are two texts. Null
    texts are empty. Texts shorter than `length` stay whole. Null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    spans = staged(repeated_spans(docs, id_col, text_col, length, gram), "repeat-spans")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    joined = rows.withColumn("text", F.xxhash64("body")).join(spans, "text", "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, spans array<struct<low:long,high:long>>, kept binary")
