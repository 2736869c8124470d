"""SimHash near-duplicates by meeting in the middle.

Fingerprints of 64 bits link at `RADIUS` = 3 or fewer differing bits. Every distinct fingerprint emits all its variants within one
flipped bit, half the radius. Two fingerprints that differ in at most two bits emit a common variant (the middle), and two that
emit a common variant differ in at most two bits: all emitters of a variant are linked without a comparison, as a star to the
least of them, so that a group of thousands costs rows in proportion to its size.

The odd third bit is taken by erasure: the 64 bits are cut into `blocks`; one of them holds at least one of three differing bits.
With that block erased the rest differs in at most two bits and meets in the middle as before. Emitters of such a variant are only
candidates; those that the first step has already joined into one component are dropped, and pairs of different components are
verified by their distance. Work follows the number of distinct fingerprints: copies are merged before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_batches, connected, staged

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCKS = 3


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 if it has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total, least = np.zeros(64, np.int64), 1 << 14
    for low in range(0, n, least):  # long texts in slices: the bits of a slice take 64 bytes a shingle
        spans = zip(starts[low : min(n, low + least)].tolist(), stops[low : min(n, low + least)].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(simhash, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        columns = [batch.column("doc_id"), batch.column("mark"), pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp"])


def _mark(docs: DataFrame) -> F.Column:
    """Hash of all columns: tells rows of one id apart."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])


def _sketched_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (made,) = _fingerprint_batches(iter([batch]))
        columns = [*made.columns, *shingles.sketch_columns(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "copy", "size", "bands", "bits"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: bool = False) -> DataFrame:
    """doc_id, mark, fp (the fingerprint as a signed long) of every row, and if wanted the sketch of its shingles. Null and empty
    texts, and texts without a word, have 0."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(docs).alias("mark"), F.col(text_col).cast("string").alias("text"))
    if sketch:
        return narrow.mapInArrow(_sketched_batches, f"doc_id long, mark long, fp long, {shingles.SKETCH}")
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, mark long, fp long")


def _flips(bits: range) -> F.Column:
    """The fingerprint itself and its variants with one of the bits flipped."""
    masks = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in bits])
    return F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))


def _erased(block: int, low: int, high: int) -> F.Column:
    """Variants of the bits outside a block, with at most one of them flipped; the block's own bits are zero."""
    mask = (1 << high) - (1 << low)
    keep = F.lit(~mask if high < 64 else (1 << low) - 1).cast("long")
    outside = F.array_distinct(F.concat(_flips(range(low)), _flips(range(high, 64))))
    return F.transform(outside, lambda v: F.struct(F.lit(block).cast("byte").alias("block"), v.bitwiseAND(keep).alias("rest")))


def near_links(distinct: DataFrame) -> DataFrame:
    """Star links (a > b) between fingerprints with a common variant: they differ in at most two bits."""
    met = distinct.select("fp", F.explode(_flips(range(64))).alias("variant"))
    least = Window.partitionBy("variant")
    return met.select(F.col("fp").alias("a"), F.min("fp").over(least).alias("b")).where("a <> b").distinct()


def far_links(distinct: DataFrame, label: DataFrame | None, blocks: int = BLOCKS) -> DataFrame:
    """Verified pairs (a > b) at `RADIUS` bits whose components differ so far; `label` has fp, root.

    Emitters of one component do not pair, so a dense group emits nothing here.
    """
    rooted = distinct.select("fp", F.col("fp").alias("root"))
    if label is not None:
        rooted = distinct.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    edges = [64 * i // blocks for i in range(blocks + 1)]
    met = rooted.select("fp", "root", F.explode(F.concat(*[_erased(i, edges[i], edges[i + 1]) for i in range(blocks)])).alias("key"))
    met = met.select("fp", "root", "key.block", "key.rest")
    bucket = Window.partitionBy("block", "rest")
    mixed = met.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low <> high")
    mixed = staged(mixed.select("block", "rest", "fp", "root"), "meetings")
    x, y = mixed.alias("x"), mixed.alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    same = (F.col("x.block") == F.col("y.block")) & (F.col("x.rest") == F.col("y.rest"))
    pairs = x.join(y, same & (F.col("x.root") > F.col("y.root")) & close)
    return pairs.select(F.greatest("x.fp", "y.fp").alias("a"), F.least("x.fp", "y.fp").alias("b")).distinct()


def classes(prints: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """fp, root: the class of every distinct fingerprint, classes being the connected components of the link graph."""
    # Few and small files, and each row becomes more than a hundred: dealt anew before.
    distinct = staged(prints.select("fp").distinct(), "prints").repartition("fp")
    near = staged(near_links(distinct), "near-links")
    label = connected(near, "fp", "root")
    far = staged(far_links(distinct, label, blocks), "far-links")
    if not far.isEmpty():
        label = connected(near.unionByName(far), "fp", "root")
    if label is None:
        return distinct.select("fp", F.col("fp").alias("root"))
    return distinct.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, itself included), of every row.

    Repeated rows stay and share a class. Null ids are passed over unless all ids of a class are null. Texts without a word have
    fingerprint zero and link like any other. An empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs.select(id_col, text_col), id_col, text_col), "simhash")
    # Copies are merged before they meet anything: a hot fingerprint is one row from here on.
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    rooted = staged(least.join(classes(prints, blocks), "fp"), "classes")
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = rooted.join(first, "root").select("fp", "component_id")
    joined = prints.join(by_print, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, similar: bool = False) -> DataFrame:
    """The documents with one row kept of each class: that of the least doc_id (null ids last; of rows of one id any, always the
    same one). With `similar`, texts whose five-word shingles have a Jaccard likeness of 0.8 or more are linked too."""
    prints = staged(fingerprints(docs, id_col, text_col, similar), "simhash")
    roots = classes(prints, blocks)
    # Near copies are seldom within three bits: fingerprints find exact copies and the closest ones, and shingles what is left of them.
    if similar:
        texts = docs.select(_mark(docs).alias("mark"), F.col(text_col).cast("string").alias("text"))
        roots = shingles.joined_classes(texts, prints, staged(roots, "classes"))
    rooted = prints.select("doc_id", "mark", "fp").join(roots, "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    pick = rooted.groupBy("root").agg(F.min(order).alias("pick")).select("pick.doc_id", "pick.mark")
    pick = staged(pick, "kept").select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_pick"))
    # The rows as one column: no name of theirs meets one used here.
    rows = docs.select(_mark(docs).alias("_mark"), F.col(id_col).cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.join(pick, (F.col("_mark") == F.col("_pick")) & F.col("_id").eqNullSafe(F.col("_doc_id")), "left_semi")
    if not prints.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_mark"])  # rows that repeat in every column
    return kept.select("_row.*")
