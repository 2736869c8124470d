"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest length are cut into pieces; full pieces are sequences of their own. All other pieces are dealt by
a hash to shards of some `SHARD_PIECES` pieces and packed there, longest first: a piece goes into the open sequence that it leaves
fullest. If it fits none, a sequence is opened whose length costs least for what it would hold: for every permitted length the pieces
still to come are filled in greedily, and the cost is divided by the tokens held. At the end each sequence is downsized to the
least permitted length that holds its contents.

Only ids and lengths move. Rows that repeat are counted before the exchange and numbered after it, so that no key is hot. A
shard is bounded by the hash, whatever the input's size, and its result depends only on its rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192)
#: Cost of a sequence beside its length, in tokens.
OVERHEAD = 64
SHARD_PIECES = 4096


def _potential(room: int, lengths: list[int], counts: dict[int, int]) -> int:
    """Tokens that a greedy fill of so much room would take from the pieces still to come."""
    filled, at = 0, bisect_left(lengths, room + 1)
    while at > 0 and room > 0:
        at = min(at, bisect_left(lengths, room + 1)) - 1
        if at < 0:
            break
        take = min(counts[lengths[at]], room // lengths[at])
        filled += take * lengths[at]
        room -= take * lengths[at]
    return filled


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset within it, its final length) of every piece; pieces come longest first and fit the longest length."""
    sizes = sorted(capacities)
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    distinct = sorted(left)
    open_room: list[tuple[int, int]] = []  # (room, sequence), in order
    opened: list[int] = []
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        left[n] -= 1
        if not left[n]:
            del left[n]
            distinct.pop(bisect_left(distinct, n))
        at = bisect_left(open_room, (n, -1))
        if at < len(open_room):
            room, b = open_room.pop(at)
        else:
            fits = [c for c in sizes if c >= n]
            room = min(fits, key=lambda c: ((c + overhead) / (n + _potential(c - n, distinct, left)), c))
            b = len(opened)
            opened.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(open_room, (room - n, b))
    final = np.array([sizes[bisect_left(sizes, u)] for u in used], np.int64)
    return bins, offsets, final[bins] if len(lengths) else final


_PACKED = "doc_id long, copy long, piece long, start long, length long, bin_id string, bin_offset long, bin_length long"


def packed(docs: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD_PIECES, id_col: str = "doc_id") -> DataFrame:
    """doc_id, copy, piece, start, length, bin_id, bin_offset, bin_length: where every piece of every document lies.

    `length` gives a row's tokens; rows without any (null or zero) have one piece of length 0 and no sequence (null bin). Rows
    that repeat in id and length are told apart by `copy`, from 1. `start` is the piece's first token. Nothing is dropped.
    """
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    top = sizes[-1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    once = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))
    each = once.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0).cast("long")))
    cut = each.select("doc_id", "copy", "n", F.explode(pieces).alias("piece"))
    cut = cut.select("doc_id", "copy", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("long").alias("length"))
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy"), F.col("piece"))
    whole = cut.where(F.col("length").isin(0, top))
    none = F.col("length") == 0
    zero = F.lit(0).cast("long")
    alone = whole.select("*", F.when(~none, name).alias("bin_id"), F.when(~none, zero).alias("bin_offset"), F.when(~none, F.lit(top).cast("long")).alias("bin_length"))
    # Each row leaves one shorter piece at most, so the rows bound the pieces.
    shards = max(1, -(-rows.count() // shard))
    sharded = cut.where(~F.col("length").isin(0, top)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "length"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = pack(ordered["length"].tolist(), sizes, overhead)
        out = ordered.assign(bin_id=[f"{s}-{b}" for s, b in zip(ordered["shard"], bins)], bin_offset=offsets, bin_length=final)
        return out.drop(columns="shard")

    return alone.unionByName(sharded.groupBy("shard").applyInPandas(fill, _PACKED))


def pieces_with_text(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The placed pieces beside the columns of their documents (of ids that don't repeat)."""
    own = docs.select(F.col(id_col).cast("long").alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"))
    names = [c for c in placed.columns if c != "doc_id"]
    where = placed.select(F.col("doc_id").alias("placed_id"), F.struct(*names).alias("placed"))
    return own.join(where, F.col("own_id").eqNullSafe(F.col("placed_id"))).select("own_row.*", "placed.*")

