"""Vector codes by Lloyd's algorithm with resident members.

A vector is cut into parts, and every part is a member of one entry of its position's codebook. Members are dealt once, by (position,
entry, salt), and lie in files of the shared folder from then on. In a round the owners take the sum of their resident members;
the entries that come of it, a few thousand numbers, go to all tasks; each member that finds another entry nearer leaves, and only those
that leave are shuffled, into a folder of arrivals of their new owners. What is left of a folder follows from the codebooks since it was
written, so that staying members are neither moved nor written again. Equal rows are one member of a higher weight; the salt
spreads the members of one entry over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, shuffle_partitions, staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Larger components would leave the exact range of squared distances.
LARGEST = 1 << 28
#: Copies of one row written out at a time.
_REPEAT = 1024

Codebooks = np.ndarray  # position, entry, component

MEMBER = "position int, entry int, salt int, vec_id long, tag long, n long, part array<long>"


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of parts of one position; ties go to the lower entry."""
    best = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for e, entry in enumerate(book):
        d = ((parts - entry) ** 2).sum(axis=1)
        nearer = d < least
        best[nearer], least[nearer] = e, d[nearer]
    return best, least


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    position = batch.column("position").to_numpy()
    parts = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, books.shape[2])
    entry, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    for p in np.unique(position):
        of = np.flatnonzero(position == p)
        entry[of], distance[of] = _nearest(parts[of], books[p])
    return entry, distance


def _first_members(books: Codebooks, salts: int):
    """Every vector (vec_id, tag, n, q) as members of the entries nearest to its parts."""
    positions, _, width = books.shape

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, positions, width)
            tag = batch.column("tag").to_numpy()
            salt = pa.array((tag.view(np.uint64) % np.uint64(salts)).astype(np.int32))
            for p in range(positions):
                entry, _ = _nearest(parts[:, p], books[p])
                flat = pa.array(np.ascontiguousarray(parts[:, p]).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), flat)
                columns = [pa.array(np.full(batch.num_rows, p, np.int32)), pa.array(entry.astype(np.int32)), salt]
                columns += [batch.column(c) for c in ("vec_id", "tag", "n")]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["position", "entry", "salt", "vec_id", "tag", "n", "part"])

    return batches


def _followed(since: list[Codebooks], leave: bool):
    """Members of a folder after the codebooks since it was written: those that stayed all along, or those that the last one moves."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, books in enumerate(since):
                entry, _ = _assigned(batch, books)
                moved = entry != batch.column("entry").to_numpy()
                take = moved if leave and i == len(since) - 1 else ~moved
                if take is moved:
                    batch = batch.set_column(1, "entry", pa.array(entry.astype(np.int32)))
                batch = batch.filter(pa.array(take))
            yield batch

    return batches


def _coded(since: list[Codebooks], last: Codebooks):
    """vec_id, tag, position, code, distance of the members still there, by the last codebooks."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _followed(since, False)(rows):
            entry, distance = _assigned(batch, last)
            columns = [batch.column(c) for c in ("vec_id", "tag", "position")] + [pa.array(entry.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "tag", "position", "code", "distance"])

    return batches


def _owned(members: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after every owner has taken the mean, rounded down, of its members; entries without members stay."""
    width = books.shape[2]
    sums = [F.sum(F.get("part", F.lit(i)) * F.col("n")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for row in members.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # one row an entry
        out[row["position"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def _whole(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, q, n, tag: integer vectors of sound rows, equal rows merged."""
    vector = F.col(vector_col)
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    rows = docs.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), q.alias("q"))
    merged = rows.groupBy("vec_id", "label", "q").agg(F.count(F.lit(1)).alias("n"))
    return merged.withColumn("tag", F.xxhash64("vec_id", "label", "q"))


def compressed(
    docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, n, codes array<int>, error of every distinct row that is kept; the codebooks).

    Rows whose vector is null or holds nulls or numbers that aren't finite are left out. Codebooks start from the `entries` smallest ids
    (null last), of rows of one id from the least vector. Equal rows are one row with their number n. The vectors must all have
    one length, which `parts` divides, and components below 2**20; anything else raises ValueError. An empty table has no
    codebooks and no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 4096)
    rows = staged(_whole(docs, id_col, vector_col, label_col), "vectors")
    sizes = rows.agg(F.min(F.size("q")), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    if sizes[0] is None:
        empty = rows.select("vec_id", "label", "n", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    if sizes[0] != sizes[1] or not sizes[0] or sizes[0] % parts or sizes[2] >= LARGEST:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components up to {sizes[2] / SCALE} can't be cut into {parts} parts")
    first = rows.groupBy("vec_id").agg(F.min("q").alias("q")).orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()  # the first codebooks
    width = sizes[0] // parts
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    deal = ("position", "entry", "salt")
    made = rows.select("vec_id", "tag", "n", "q").mapInArrow(_first_members(books, shuffle_partitions(spark)), MEMBER)
    folders: list[tuple[DataFrame, list[Codebooks]]] = [(staged(made.repartition(*deal), "vector-members"), [])]
    for turn in range(rounds):
        if turn:  # only members that change their entry go through a shuffle
            for _, since in folders:
                since.append(books)
            leaving = [folder.mapInArrow(_followed(since, True), MEMBER) for folder, since in folders]
            arrivals = staged(_union(leaving).repartition(*deal), "vector-arrivals")
            folders.append((arrivals, []))
        books = _owned(_union([f.mapInArrow(_followed(s, False), MEMBER) if s else f for f, s in folders]), books)
    kinds = "vec_id long, tag long, position int, code int, distance long"
    coded = _union([f.mapInArrow(_coded(s, books), kinds) for f, s in folders])
    lists = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda m: m["code"])
    whole = coded.groupBy("vec_id", "tag").agg(lists.alias("codes"), F.sum("distance").alias("error"))
    one = F.struct("vec_id", "tag")
    named = rows.select("label", "n", one.alias("one")).join(whole.select(one.alias("_one"), "codes", "error"), F.col("one").eqNullSafe(F.col("_one")))
    return named.select("one.vec_id", "label", "n", "codes", "error"), books


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def codebook_digest(books: Codebooks) -> str:
    """sha256 of all components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels, null being one), codebooks_sha256."""
    found, books = compressed(docs, id_col, vector_col, label_col)
    found = staged(found, "vector-codes")
    digits = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error") * F.col("n")).alias("label_error"))
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    rows = joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"), "n")
    # Equal rows again, in portions.
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_REPEAT}"))))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_REPEAT), F.col("n") - F.col("_i") * _REPEAT))))
    return rows.drop("n", "_i", "_j")
