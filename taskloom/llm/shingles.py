"""Pairs of texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates share one of `BANDS` bands of `ROWS` least hashes each: a pair of likeness 0.8 does with a probability of
1 - (1 - 0.8**7)**48 = 0.99999, likelier ones more surely, one of 0.5 with 0.31, one of 0.3 with 0.01. One bit of each least hash is kept as
well; where two texts differ in more than `APART` of these bits (a pair of 0.8 does so once in 100,000 times) they are not looked at
further. All others are verified on the sets themselves.

Copies are merged before. Texts of one component are not compared. In a few turns every text is held against one leader of each
bucket it lies in, first against the text that shares most buckets with others, the middle of a group of near copies; so a group becomes one
component with rows in proportion to its size. What is then left of different components in one bucket meets by an exact prefix
filter: two sets of 0.8 share a shingle among the rarest few of either, so that a text with its own edits, which no leader held, meets
nobody through what the whole group has in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staging
from .common import arrow_batches, connected, staged

WORDS = 5
ROWS = 7
BANDS = 48
SEED = 43
#: Differing bits, of ROWS * BANDS, beyond which a pair is not near: 34 are expected at 0.8, with a deviation of 5.5.
APART = 58
#: Turns with leaders before the prefix filter.
TURNS = 3
#: Shingles hashed at a time.
CHUNK = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles of a text in ascending order; a text of fewer words is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = out * _STEP + words[k : k + n]
    return np.unique(_mixed(out))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the buckets of every set, one for each band; a bit of each least hash, packed in longs); no set may be empty."""
    keys, low = np.zeros((len(sets), BANDS), np.uint64), 0
    bits = np.zeros((len(sets), -(-ROWS * BANDS // 64) * 64), np.uint8)
    while low < len(sets):
        high, size = low + 1, len(sets[low])
        while high < len(sets) and size + len(sets[high]) <= CHUNK:
            size += len(sets[high])
            high += 1
        flat = np.concatenate(sets[low:high])
        starts = np.cumsum([0, *map(len, sets[low : high - 1])])
        for band in range(BANDS):
            key = np.full(high - low, band, np.uint64)
            for j in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat(flat * _ODD[0, j] + _ODD[1, j], starts)
                key = key * _STEP + least
                bits[low:high, j] = (_mixed(least) & np.uint64(1)).astype(np.uint8)
            keys[low:high, band] = _mixed(key)
        low = high
    return keys, np.packbits(bits, axis=1).view(np.int64)


def _lists(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, at the given places; -1 is null."""
    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).reshape(-1)), values.shape[1]).cast(pa.list_(pa.int64()))
    return lists.take(pa.array(places, mask=places < 0))


def sketch_columns(texts: list[str | None]) -> list[pa.Array]:
    """copy (hash of the words), size (of the set), bands and bits (null for a text without words) of every text."""
    sets = [shingle_set(t) for t in texts]
    copies = np.fromiter((xxhash.xxh64_intdigest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()), SEED) for t in texts), np.uint64, len(texts))
    sizes = np.fromiter(map(len, sets), np.int32, len(sets))
    some = np.flatnonzero(sizes)
    keys, bits = sketches([sets[i] for i in some])
    places = np.full(len(texts), -1)
    places[some] = np.arange(len(some))
    return [pa.array(copies.view(np.int64)), pa.array(sizes), _lists(keys.view(np.int64), places), _lists(bits, places)]


SKETCH = "copy long, size int, bands array<long>, bits array<long>"


def _sets(batches):
    for batch in batches:
        lists = pa.array([shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("copy"), lists], ["copy", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a > b) of roots of the pairs at 0.8 or more; `pairs` has copy, root, other, other_root."""
    met = pairs.join(sets, "copy").join(sets.select(F.col("copy").alias("other"), F.col("shingles").alias("others")), "other")
    shared = F.size(F.array_intersect("shingles", "others"))
    near = met.where(9 * shared >= 4 * (F.size("shingles") + F.size("others")))
    return near.select(F.greatest("root", "other_root").alias("a"), F.least("root", "other_root").alias("b")).distinct()


def _near(x: str, y: str) -> F.Column:
    """Sizes at which a likeness of 0.8 is possible, and bits at which it is likely."""
    apart = [F.bit_count(F.get(f"{x}bits", F.lit(i)).bitwiseXOR(F.get(f"{y}bits", F.lit(i)))) for i in range(-(-ROWS * BANDS // 64))]
    return (5 * F.least(f"{x}size", f"{y}size") >= 4 * F.greatest(f"{x}size", f"{y}size")) & (sum(apart[1:], apart[0]) <= APART)


def _relabelled(rooted: DataFrame, links: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """`rooted` with the roots that hold after the links between roots."""
    to = connected(links, "root", "to")
    if to is None:
        return staged(rooted, label, lasting) if lasting else rooted
    moved = rooted.join(to, "root", "left")
    return staged(moved.select(*[F.coalesce("to", "root").alias("root") if c == "root" else F.col(c) for c in rooted.columns]), label, lasting)


def _met(prints: DataFrame, rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: copy, mark, size, bits, root; meetings: bucket, copy, crowd) of texts that share a bucket with one of another root.

    crowd is the same for all meetings of a text: how many others it meets, on a logarithmic scale.
    """
    first = [F.first(c).alias(c) for c in ("fp", "size", "bits", "bands")]
    distinct = prints.where("bands IS NOT NULL").groupBy("copy").agg(F.min("mark").alias("mark"), *first)
    texts = staged(distinct.join(rooted, "fp").select("copy", "mark", "size", "bits", "bands", "root"), "similar-texts")
    placed = texts.select("copy", "root", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    met = staged(placed.join(shared.select("bucket", "n"), "bucket").select("bucket", "copy", "n"), "similar-meetings")
    crowd = staged(met.groupBy("copy").agg(F.sum(F.log2("n")).alias("crowd")), "similar-crowds")
    return texts.drop("bands").join(crowd.select("copy"), "copy", "left_semi"), met.join(crowd, "copy").select("bucket", "copy", "crowd")


def _prefix_pairs(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of texts (copy, root, size, bits) of different roots that may be near: copy, root, other, other_root.

    Sets of x and y shingles at 0.8 share o = ceil(4 / 9 * (x + y)) of them at least. In one order of all shingles, the rarest first, they then
    share one among the first x - o + 1 of the one and the first y - o + 1 of the other.
    """
    each = texts.select("copy").join(sets, "copy").select("copy", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    order = each.join(often, "shingle").groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    # The longest prefix is that against the smallest set that can be near, of 4/5 the size.
    longest = F.col("size") - F.ceil(F.col("size") * 0.8 - 1e-9) + 1
    placed = texts.join(order, "copy").select("copy", "root", "size", "bits", F.posexplode(F.slice("all", F.lit(1), longest.cast("int"))).alias("place", "s"))
    placed = staged(placed.select("copy", "root", "size", "bits", "place", F.col("s.shingle").alias("shingle")), "similar-prefixes")
    other = placed.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("copy", "root", "size", "bits", "place")])
    shared = F.floor((4 * (F.col("size") + F.col("other_size")) + 8) / 9)
    inside = (F.col("place") <= F.col("size") - shared) & (F.col("other_place") <= F.col("other_size") - shared)
    met = placed.join(other, "shingle").where((F.col("root") < F.col("other_root")) & inside & _near("", "other_"))
    return met.select("copy", "root", F.col("other_copy").alias("other"), "other_root").distinct()


def joined_classes(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """fp, root of `rooted` after classes with texts at 0.8 or more are joined. `docs` has mark, text; `prints` mark, fp and the sketch.

    Texts without words are near no other; a text of fewer than five words is one shingle. What is written on the way is removed.
    """
    arrow_batches(docs.sparkSession)
    with staging():
        texts, met = _met(prints, rooted)
        texts, met = staged(texts, "similar-texts"), staged(met, "similar-meetings")
        if met.isEmpty():
            return staged(rooted, "similar-roots", lasting=True)
        made = docs.join(texts.select("copy", "mark"), "mark").select("copy", "text").mapInArrow(_sets, "copy long, shingles array<long>")
        sets = staged(made.groupBy("copy").agg(F.first("shingles").alias("shingles")), "similar-sets")
        fact = ["copy", "root", "size", "bits"]
        for turn in range(TURNS):
            order = F.col("crowd") if turn == 0 else F.xxhash64("copy", F.lit(turn)).cast("double")
            placed = met.join(texts.select(*fact), "copy")
            lead = F.max(F.struct(order.alias("order"), *fact)).alias("lead")
            mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead).where("low <> high").select("bucket", "lead.*")
            mixed = mixed.select("bucket", *[F.col(c).alias(f"other_{c}") for c in fact])
            held = placed.join(mixed, "bucket").where((F.col("root") != F.col("other_root")) & _near("", "other_"))
            pairs = held.select("copy", "root", F.col("other_copy").alias("other"), "other_root").distinct()
            links = staged(_verified(pairs, sets), "similar-links")
            if not links.isEmpty():
                rooted, texts = _relabelled(rooted, links, "similar-roots"), _relabelled(texts, links, "similar-texts")
        placed = met.join(texts.select(*fact), "copy")
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        left = staged(placed.join(mixed, "bucket", "left_semi").select("bucket", *fact), "similar-left")
        pairs = _prefix_pairs(left.drop("bucket").distinct(), sets)
        return _relabelled(rooted, staged(_verified(pairs, sets), "similar-links"), "similar-roots", lasting=True)
