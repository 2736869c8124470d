"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its s-mers lies at its first or last s-mer. Whether a k-mer is chosen
depends on its own characters alone, so that equal passages choose equal anchors whatever stands around them. The fingerprint keeps
the `ANCHORS` anchors of least hash, each with the position where it first occurs; likeness counts the anchors that two fingerprints
share in the same order (a longest increasing run of positions) among the least of their union.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, range_bounds, range_of, shuffle_partitions

K = 20
S = 9
ANCHORS = 96

_BASE = 0x9E3779B97F4A7C15
_POWERS = [pow(_BASE, i, 1 << 64) for i in range(65)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_hashes(codes: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hash of every window of each width, built from windows of powers of two."""
    by_power, width = {1: codes}, 1
    while width * 2 <= max(widths):
        low = by_power[width]
        by_power[width * 2] = low[:-width] * np.uint64(_POWERS[width]) + low[width:]
        width *= 2
    out = []
    for wanted in widths:
        have, got = None, 0
        for w in sorted(by_power, reverse=True):
            if got + w <= wanted:
                part = by_power[w]
                have = part if have is None else have[: len(codes) - got - w + 1] * np.uint64(_POWERS[w]) + part[got:]
                got += w
        out.append(have)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, got = values, 1
    while got * 2 <= width:
        have = np.minimum(have[:-got], have[got:])
        got *= 2
    return have if got == width else np.minimum(have[: len(values) - width + 1], have[width - got :])


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of a text; a shorter text that isn't empty is one anchor as a whole."""
    n = len(text)
    if n < k:
        whole = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1)
        return np.array([whole] if n else [], np.uint64), np.zeros(min(n, 1), np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    small, large = _window_hashes(codes, (s, k))
    small = _mixed(small)
    inner = k - s
    least = _sliding_min(small, inner + 1)
    at = np.flatnonzero((small[: n - k + 1] == least) | (small[inner : inner + n - k + 1] == least))
    return _mixed(large[at]), at


def sketch(text: str | None, anchors: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of least hash (32 bits), each at its first position, in order of hash."""
    hashes, at = closed_syncmers(text or "")
    keys = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(keys) > 8 * anchors:  # all repeats of the least come along, so this changes nothing
        bound = np.partition(keys, 4 * anchors)[4 * anchors]
        few = np.flatnonzero(keys <= bound)
        if len(np.unique(keys[few])) >= anchors:
            keys, at = keys[few], at[few]
    least, first = np.unique(keys, return_index=True)
    return least[:anchors], at[first[:anchors]].astype(np.uint32)


def packed(keys: np.ndarray, at: np.ndarray) -> str:
    """A fingerprint as text: base64 of the anchors' hashes, then of their positions."""
    return base64.b64encode(keys.astype("<u4").tobytes() + at.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], anchors: int = ANCHORS) -> float:
    """Share of the least anchors of the union that both have in the same order; 1 for two empty fingerprints."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    union = np.union1d(a[0], b[0])[:anchors]
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = common <= union[-1]
    order = np.argsort(a[1][i[inside]], kind="stable")
    tails: list[int] = []
    for p in b[1][j[inside]][order].tolist():  # longest increasing run of positions
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails) / len(union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_anchors, fingerprint of every row; null and empty texts have none and the empty fingerprint."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [sketch(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(f[0]) for f in found], pa.int32()), pa.array([packed(*f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_anchors", "fingerprint"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"doc_id {kind}, n_anchors int, fingerprint string")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against its edited text and the text that follows; the last row of a part only follows."""

    def result(waiting, part, text, found):
        out = []
        for doc_id, own, own_print in waiting:
            cut = len(own) // 3
            edited = own[: len(own) - cut] + text[:cut] if cut else own
            other = sketch(edited) if cut else own_print
            near = likeness(own_print, other), likeness(own_print, found)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(own), digest, packed(*own_print), packed(*other), *near))
        return out

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _EDITED.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    part = current = None
    waiting: list[tuple] = []  # rows of the current id
    for batch in rows:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "follows", "text"))
        for at, doc_id, follows, text in zip(*columns):
            if at != part:
                waiting, current = [], None
            elif doc_id == current and not follows:
                waiting.append((doc_id, text, sketch(text)))
                continue
            found = sketch(text)
            out += result(waiting, part, text, found)
            part, current = at, doc_id
            waiting = [] if follows else [(doc_id, text, found)]
        if out:
            yield batch_of(out)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced from the next document.

    The next document is that of the next smaller id, after the last that of the largest. Texts are dealt once, by ranges of the id;
    the first document of a range is also sent, as a follower, to the range before, so no window spans the table. Rows that
    repeat an id share the next document, which is the one of least text among its rows. Null ids count as the smallest
    id there can be. Null texts count as empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 256)
    lowest = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    bounds = range_bounds(rows, "doc_id", shuffle_partitions(spark))
    if not bounds:
        return spark.createDataFrame([], _EDITED)
    # The head of a range is its largest id; it follows the range above. The largest of all follows the lowest range.
    tops = {r["part"]: r["top"] for r in rows.groupBy(range_of("doc_id", bounds).alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    held = sorted(tops)  # at most one a range
    heads = [(tops[p], held[(i + 1) % len(held)]) for i, p in enumerate(held)]
    placed = rows.withColumn("part", range_of("doc_id", bounds))
    sends = F.array(*[F.struct(F.lit(t).cast("long").alias("top"), F.lit(p).alias("part")) for t, p in heads])
    also = F.transform(F.filter(sends, lambda s: s["top"] == F.col("doc_id")), lambda s: F.struct(s["part"].alias("part"), F.lit(True).alias("follows")))
    copies = placed.select("doc_id", "text", F.explode(F.concat(F.array(F.struct("part", F.lit(False).alias("follows"))), also)).alias("to"))
    dealt = copies.select("doc_id", "text", "to.part", "to.follows").repartitionById(len(bounds), F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "follows", F.desc("doc_id"), "text").select("part", "doc_id", "follows", "text")
    found = ordered.mapInArrow(_compared, _EDITED)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(lowest)))
