"""Token ids in a file format of shuffled planes.

Ids are cut into blocks of a fixed number (the last of a segment is shorter). A block is transposed: all lowest bytes of its ids, then
all second bytes and so on (byte planes), or all lowest bits, then all second bits (bit planes). Each plane is compressed by
zstandard on its own; planes of zeros take a few bytes. The chunk index of a segment lists, for every block and plane, where its
bytes lie, so that a reader takes the blocks it needs.

A segment holds whole documents, some `SEGMENT_IDS` ids, and is one row of a Parquet file: index columns, and the payload. Parts, and
segments within a part, follow ascending document ids. Spark writes the files, to any store it can reach; a lost executor's tasks
run again and only committed files count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, in_ranges, range_bounds, shuffle_partitions
from .subwords import ChunkEncoder, json_encoder, vocabulary_path

BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 18
END_ID = 2
LEVEL = 1

SEGMENTS = (
    "part int, segment int, part_start bigint, doc_ids array<bigint>, doc_tokens array<int>, n_ids bigint, block_ids int, planes string, "
    "plane_bytes array<int>, crc32 bigint, payload binary"
)


def shuffled(ids: np.ndarray, planes: str = "byte", block: int = BLOCK_IDS, level: int = LEVEL) -> tuple[list[int], bytes]:
    """(compressed size of every plane, block by block; the planes' bytes) of unsigned 32-bit ids."""
    if planes not in ("byte", "bit"):
        raise ValueError("planes are 'byte' or 'bit'")
    packer = zstandard.ZstdCompressor(level=level)
    sizes, out = [], []
    for low in range(0, len(ids), block):
        rows = np.ascontiguousarray(ids[low : low + block], "<u4").view(np.uint8).reshape(-1, 4)
        if planes == "bit":
            rows = np.unpackbits(rows, axis=1, bitorder="little")
            stripes = [np.packbits(rows[:, b]).tobytes() for b in range(32)]
        else:
            stripes = [rows[:, b].tobytes() for b in range(4)]
        for stripe in stripes:
            pressed = packer.compress(stripe)
            sizes.append(len(pressed))
            out.append(pressed)
    return sizes, b"".join(out)


def restored(sizes: list[int], payload: bytes, count: int, planes: str = "byte", block: int = BLOCK_IDS) -> np.ndarray:
    """The ids again."""
    opener = zstandard.ZstdDecompressor()
    ids, at, index = np.zeros(count, "<u4"), 0, 0
    for low in range(0, count, block):
        n = min(block, count - low)
        rows = np.zeros((n, 32 if planes == "bit" else 4), np.uint8)
        for b in range(rows.shape[1]):
            plain = np.frombuffer(opener.decompress(payload[at : at + sizes[index]]), np.uint8)
            rows[:, b] = np.unpackbits(plain, count=n) if planes == "bit" else plain
            at, index = at + sizes[index], index + 1
        if planes == "bit":
            rows = np.packbits(rows, axis=1, bitorder="little")
        ids[low : low + n] = np.ascontiguousarray(rows).view("<u4").ravel()
    return ids


def _segments(path: str, planes: str, block: int, wanted: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, json_encoder(path))
        part, number, before, doc_ids, doc_tokens, held, size = None, 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            sizes, payload = shuffled(ids, planes, block)
            row = {
                "part": part, "segment": number, "part_start": before, "doc_ids": doc_ids, "doc_tokens": doc_tokens, "n_ids": len(ids), "block_ids": block,
                "planes": planes, "plane_bytes": sizes, "crc32": zlib.crc32(ids.astype("<u4").tobytes()), "payload": payload,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in rows:
            ids, starts = encoder.ids(batch.column("text"))
            for n, (at, doc_id) in enumerate(zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist())):
                if held and (at != part or size >= wanted):
                    yield close()
                    number, before = (number + 1, before + size) if at == part else (0, 0)
                    doc_ids, doc_tokens, held, size = [], [], [], 0
                part = at
                own = np.append(ids[starts[n] : starts[n + 1]].astype(np.uint32), np.uint32(END_ID))
                held.append(own)
                doc_ids.append(doc_id)
                doc_tokens.append(len(own))
                size += len(own)
        if held:
            yield close()

    return batches


#: Encoders of this worker by the path of their vocabulary.
_ENCODERS: dict[str, ChunkEncoder] = {}

_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())),
        ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("planes", pa.string()), ("plane_bytes", pa.list_(pa.int32())),
        ("crc32", pa.int64()), ("payload", pa.binary()),
    ]
)


def write_ids(
    docs: DataFrame, path: str, vocabulary: str | None = None, planes: str = "byte", block: int = BLOCK_IDS, segment: int = SEGMENT_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of every text, each with `END_ID` appended, in ascending order of the document id.

    Null ids come first; rows of one id come in the order of their texts. Null texts are empty: the end id alone. An empty table
    writes a folder without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 2048)
    lowest = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    bounds = range_bounds(rows, "doc_id", shuffle_partitions(spark))
    ordered = in_ranges(rows, "doc_id", bounds).sortWithinPartitions("part", "doc_id", "text").select("part", "doc_id", "text")
    where = vocabulary or vocabulary_path("byte_bpe_50k.json")
    made = ordered.mapInArrow(_segments(where, planes, block, segment), SEGMENTS)
    ids = F.transform("doc_ids", lambda i: F.nullif(i, F.lit(lowest)))
    made.withColumn("doc_ids", ids).write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends of the documents, their sizes) of a segment, checked against its crc."""
    ids = restored(row["plane_bytes"], row["payload"], row["n_ids"], row["planes"], row["block_ids"])
    if zlib.crc32(ids.tobytes()) != row["crc32"]:
        raise ValueError(f"segment {row['part']}/{row['segment']} is damaged")
    sizes = np.array(row["doc_tokens"], np.int64)
    return ids, np.cumsum(sizes), sizes


def _documents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row in batch.to_pylist():
            ids, ends, sizes = _opened(row)
            offsets = pa.array(np.concatenate((ends - sizes, ends[-1:])).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document."""
    arrow_batches(spark, 4)
    return spark.read.schema(SEGMENTS).parquet(path).mapInArrow(_documents, "doc_id long, ids array<int>")


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row in batch.to_pylist():
            ids, ends, sizes = _opened(row)
            sums = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), sizes.tolist())]
            starts = row["part_base"] + row["part_start"] + ends - sizes
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files.

    A segment knows the ids of its part before it; the sums of the parts, of which there are as many as shuffle partitions, are
    added up in order and go out with the scan.
    """
    arrow_batches(spark, 4)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    per_part = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a part
    before, total = [], 0
    for part in sorted(per_part):
        before.append((part, total))
        total += per_part[part]
    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    joined = segments.join(F.broadcast(spark.createDataFrame(before, "part int, part_base long")), "part")
    return joined.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
