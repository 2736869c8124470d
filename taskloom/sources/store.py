"""A store of tables that takes changes of them, from any number of writers.

Every table is a list of Parquet folders: parts of rows that were appended, or, where rows change, buckets of their key's hash. A
commit writes folders of its own, whose names no other writer can take, and then the manifest of the next version, which says which
folders the tables consist of; it is created last and never overwritten. A writer that finds its version taken looks at what the
others did: if they left alone what it has rewritten, it commits anew on top of them, else it gets `VersionTaken` and its folders are refuse
for `vacuum`. Written data is never overwritten.

Buckets grow by linear hashing: with a table's rows the number of its buckets grows one by one, each new one taking its rows from one old
one, so that a bucket keeps about `BUCKET_ROWS` rows and a commit of k rows rewrites at most k buckets and those that it splits. Parts carry
the range of their ids and of `created_at`, so that deletes pass over, or drop unread, the parts they don't cut. The changed rows of the
last commits stay readable as a feed.

On a file system whose `create` is not exclusive (some object stores) the manifests need one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType, TimestampType

from ..model import KEYS, Tables
from ..operators.delta import Append, Delete, DeleteBefore, Upsert

MANIFEST = "manifest"
#: Tables whose rows change, kept in buckets of their key. Others are kept so once they are first written by an upsert.
BUCKETED = {"tasks": ("task_id",), "sessions": ("session_id",), "memory": ("memory_id",), "tool_registry": ("tool_id",)}
#: Rows of a bucket on average. A table of ten thousand million rows has some 76,000 buckets then.
BUCKET_ROWS = 1 << 17
#: Commits whose changed rows a table's feed goes back to.
FEED_COMMITS = 256

Change = DataFrame | Append | Upsert | Delete | DeleteBefore
Changes = Change | Sequence[Change]


class VersionTaken(RuntimeError):
    """Other writers have changed, since the version this change was computed from, what it changes too."""


# ---------------------------------------------------------------- files


def _file(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _manifest_path(directory: str, version: int) -> str:
    return f"{directory}/{MANIFEST}/{version}.json"


def _exists(spark: SparkSession, path: str) -> bool:
    system, file = _file(spark, path)
    return system.exists(file)


def _text(spark: SparkSession, path: str) -> str:
    system, file = _file(spark, path)
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """Write a small file; False if it is there already and may not be overwritten."""
    system, file = _file(spark, path)
    if not overwrite and system.exists(file):
        return False
    try:
        stream = system.create(file, overwrite)  # fails if another writer was faster
    except Exception:
        if overwrite or not system.exists(file):
            raise
        return False
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _remove(spark: SparkSession, path: str) -> None:
    system, folder = _file(spark, path)
    system.delete(folder, True)


# ---------------------------------------------------------------- manifests


def newest_version(spark: SparkSession, directory: str) -> int:
    """The newest version, -1 for an empty store: the number kept under a fixed name, and any that came after it."""
    hint = f"{directory}/{MANIFEST}/newest"
    text = _text(spark, hint) if _exists(spark, hint) else ""
    version = int(text) if text else -1
    while _exists(spark, _manifest_path(directory, version + 1)):
        version += 1
    return version


def manifest(spark: SparkSession, directory: str, version: int | None = None) -> dict:
    """What a version (the newest by default) consists of: {version, tables, streams, seen, last_ids}."""
    version = newest_version(spark, directory) if version is None else version
    if version < 0:
        return {"version": -1, "tables": {}, "streams": {}, "seen": {}, "last_ids": {}}
    for patience in range(20):  # its writer may be just about to fill it
        text = _text(spark, _manifest_path(directory, version))
        if text.endswith("}"):
            return json.loads(text)
        time.sleep(0.05 * (patience + 1))
    raise RuntimeError(f"the manifest of version {version} in {directory} is unfinished: its writer was lost; remove the file")


def committed_batch(spark: SparkSession, directory: str, stream: str) -> int:
    """The last batch a stream has committed, -1 for none."""
    return manifest(spark, directory)["streams"].get(stream, -1)


def seen_version(spark: SparkSession, directory: str, stream: str) -> int | None:
    """The version that a stream's last commit was computed from."""
    return manifest(spark, directory)["seen"].get(stream)


def _schema_of(entry: dict) -> StructType:
    return StructType.fromJson(entry["schema"])


def _paths(directory: str, entry: dict) -> list[str]:
    return [f"{directory}/{p['path']}" for p in [*entry["parts"], *entry["cells"].values()]]


def _scan(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


# ---------------------------------------------------------------- buckets


def grown(grid: tuple[int, int], rows: int, bucket_rows: int) -> tuple[int, int]:
    """(level, next) for a number of rows; the number of buckets, 2**level + next, never falls."""
    wanted = max((1 << grid[0]) + grid[1], -(-rows // bucket_rows), 1)
    level = wanted.bit_length() - 1
    return level, wanted - (1 << level)


def bucket_number(hashed: int, grid: tuple[int, int]) -> int:
    """Bucket of a hash: by `level` bits, and by one more where that bucket has been split."""
    low = hashed % (1 << grid[0])
    return low if low >= grid[1] else hashed % (1 << (grid[0] + 1))


def _bucket(key: Sequence[str], grid: tuple[int, int]) -> Column:
    hashed = F.xxhash64(*key)
    low = F.pmod(hashed, F.lit(1 << grid[0]))
    return F.when(low >= grid[1], low).otherwise(F.pmod(hashed, F.lit(1 << (grid[0] + 1))))


def _fresh(name: str, version: int) -> str:
    return f"{name}/v={version}-{uuid.uuid4().hex[:12]}"


def _write_cells(rows: DataFrame, key: Sequence[str], grid: tuple[int, int], directory: str, where: str) -> dict[str, dict]:
    """Write rows by bucket; {bucket: {path, rows}} of those that have any."""
    spark = rows.sparkSession
    rows.withColumn("bucket", _bucket(key, grid)).repartition("bucket").write.partitionBy("bucket").parquet(f"{directory}/{where}")
    system, folder = _file(spark, f"{directory}/{where}")
    if not any(f.getPath().getName().startswith("bucket=") for f in system.listStatus(folder)):
        return {}
    counted = spark.read.parquet(f"{directory}/{where}").groupBy("bucket").count().collect()  # one row a bucket written
    return {str(r["bucket"]): {"path": f"{where}/bucket={r['bucket']}", "rows": r["count"]} for r in counted}


# ---------------------------------------------------------------- what a change writes


@dataclass
class _Made:
    """The files of a change, and what of the table they stand for."""

    entry: dict | None = None  # a whole new table
    parts: list[dict] = field(default_factory=list)  # parts added
    gone: set[str] = field(default_factory=set)  # paths of parts they replace
    cells: dict[str, dict] = field(default_factory=dict)
    touched: set[str] = field(default_factory=set)  # buckets they replace
    grid: list[int] | None = None
    deltas: list[dict] = field(default_factory=list)
    ids: list[int] | None = None  # least and largest id written
    key: Sequence[str] | None = None


def _id_of(schema: StructType, name: str) -> str | None:
    """The column of a table that is its one integer key, if it has such."""
    key = KEYS.get(name, ())
    return key[0] if len(key) == 1 and key[0] in schema.names and isinstance(schema[key[0]].dataType, IntegralType) else None


def _described(spark: SparkSession, directory: str, where: str, name: str, schema: StructType) -> dict:
    """A written folder with its number of rows, the range of its ids and of created_at: one narrow scan of files just written."""
    key = _id_of(schema, name)
    timed = "created_at" in schema.names and isinstance(schema["created_at"].dataType, TimestampType)
    ids, moment = F.col(key).cast("long") if key else F.lit(None), F.unix_micros("created_at") if timed else F.lit(None)
    row = _scan(spark, [f"{directory}/{where}"], schema).agg(
        F.count(F.lit(1)), F.min(ids), F.max(ids), F.min(moment), F.max(moment), F.count_if(moment.isNull())
    ).first()
    part = {"path": where, "rows": row[0]}
    if key:
        part["ids"] = [row[1], row[2]]
    if timed:
        part["times"] = [row[3], row[4], row[5]]
    return part


def _joined_ids(*ranges: Sequence[int | None] | None) -> list[int] | None:
    known = [r for r in ranges if r and r[0] is not None]
    return [min(r[0] for r in known), max(r[1] for r in known)] if known else None


class _Writer:
    """Writes the changes of one table on top of one version."""

    def __init__(self, spark: SparkSession, directory: str, state: dict, name: str, bucket_rows: int):
        self.spark, self.directory, self.state, self.name, self.bucket_rows = spark, directory, state, name, bucket_rows
        self.entry = state["tables"].get(name)
        self.version = state["version"] + 1

    def written(self, rows: DataFrame, schema: StructType) -> dict:
        where = _fresh(self.name, self.version)
        rows.write.parquet(f"{self.directory}/{where}")
        return _described(self.spark, self.directory, where, self.name, schema)

    def read(self, *paths: str, schema: StructType | None = None) -> DataFrame:
        return _scan(self.spark, [f"{self.directory}/{p}" for p in paths], schema or _schema_of(self.entry))

    def whole(self, rows: DataFrame, key: Sequence[str] | None) -> _Made:
        """A table written anew."""
        entry = {"schema": rows.schema.jsonValue(), "born": uuid.uuid4().hex, "key": list(key) if key else None, "parts": [], "cells": {}, "grid": [0, 0], "deltas": [], "feed_after": -1}
        first = self.written(rows, rows.schema)
        if not key:
            entry["parts"] = [first]
        else:
            grid = grown((0, 0), first["rows"], self.bucket_rows)
            entry["grid"] = list(grid)
            entry["cells"] = _write_cells(self.read(first["path"], schema=rows.schema), key, grid, self.directory, _fresh(self.name, self.version))
            _remove(self.spark, f"{self.directory}/{first['path']}")  # this writer's own, and in no manifest
        return _Made(entry=entry, ids=_joined_ids(first.get("ids")))

    def made(self, change: Changes) -> _Made:
        steps = [change] if isinstance(change, Change) else list(change)
        if len(steps) == 1 and isinstance(steps[0], DataFrame):
            return self.whole(steps[0], BUCKETED.get(self.name))
        if any(isinstance(s, DataFrame) for s in steps):
            raise ValueError("a frame replaces its table and stands alone")
        if self.entry is None:
            upserts = [s for s in steps if isinstance(s, Upsert)]
            if len(steps) != 1 or not isinstance(steps[0], Append | Upsert):
                raise ValueError(f"there is no table {self.name} to change")
            return self.whole(steps[0].rows, upserts[0].key if upserts else BUCKETED.get(self.name))
        names = _schema_of(self.entry).names
        steps = [replace(s, rows=s.rows.select(*names)) if isinstance(s, Append | Upsert) else s for s in steps]
        return self.by_bucket(steps) if self.entry["key"] else self.by_part(steps)

    def delta(self, step: Append | Upsert | Delete, schema: StructType) -> tuple[DataFrame, dict]:
        """The step's rows, written once: they are read for the buckets they touch, for the rewriting, and by the feed."""
        part = self.written(step.rows, schema)
        return self.read(part["path"], schema=schema), part

    def staged(self, steps: list, key: Sequence[str], deltas: list[dict], ids: list) -> list:
        """The steps over written rows; a delete by time becomes one by key."""
        schema, out = _schema_of(self.entry), []
        for step in steps:
            if isinstance(step, DeleteBefore):
                everything = self.read(*[p["path"] for p in [*self.entry["parts"], *self.entry["cells"].values()]])
                step = Delete(everything.where(step.gone()).select(*key), tuple(key))
            deleting = isinstance(step, Delete)
            if deleting and list(step.key) != list(key):
                raise ValueError(f"rows of {self.name} are deleted by {key}")
            kind = StructType([schema[k] for k in key]) if deleting else schema
            rows, part = self.delta(Delete(step.rows.select(*key).distinct(), step.key) if deleting else step, kind)
            deltas.append({"path": part["path"], "version": self.version, "delete": deleting})
            if not deleting:
                ids.append(part.get("ids"))
            out.append(Delete(rows, tuple(key)) if deleting else Upsert(rows, tuple(key)))
        return out

    def by_bucket(self, steps: list) -> _Made:
        entry, key, old = self.entry, self.entry["key"], tuple(self.entry["grid"])
        deltas, ids = [], []
        steps = self.staged(steps, key, deltas, ids)
        hit: set[int] = set()
        added = 0
        for step in steps:
            rows = step.rows.groupBy(_bucket(key, old).alias("b")).count().collect()  # at most one row a bucket
            hit |= {r["b"] for r in rows}
            added += sum(r["count"] for r in rows) if isinstance(step, Upsert) else 0
        if not hit:
            return _Made(touched=set())
        new = grown(old, sum(c["rows"] for c in entry["cells"].values()) + added, self.bucket_rows)
        splits = range((1 << old[0]) + old[1], (1 << new[0]) + new[1])
        touched = {str(b) for b in hit | {bucket_number(j, old) for j in splits}}
        after = self.read(*[entry["cells"][b]["path"] for b in sorted(touched & set(entry["cells"]))])
        for step in steps:
            after = step.after(after)
        cells = _write_cells(after, key, new, self.directory, _fresh(self.name, self.version))
        return _Made(cells=cells, touched=touched, grid=list(new), deltas=deltas, ids=_joined_ids(*ids), key=key)

    def by_part(self, steps: list) -> _Made:
        if all(isinstance(s, Append) for s in steps):
            parts = [self.written(s.rows, _schema_of(self.entry)) for s in steps]
            parts = [p for p in parts if p["rows"]]
            feed = [{"path": p["path"], "version": self.version, "delete": False} for p in parts]
            return _Made(parts=parts, ids=_joined_ids(*[p.get("ids") for p in parts]), deltas=feed)
        if all(isinstance(s, DeleteBefore) for s in steps):
            return self.without_old(steps)
        key = next((s.key for s in steps if isinstance(s, Upsert | Delete)), KEYS.get(self.name))
        deltas, ids = [], []
        steps = self.staged(steps, key, deltas, ids)
        hit = self.parts_with([s.rows for s in steps], key)
        rows = self.read(*[p["path"] for p in hit])
        for step in steps:
            rows = step.after(rows)
        part = self.written(rows, _schema_of(self.entry))
        return _Made(parts=[part] if part["rows"] else [], gone={p["path"] for p in hit}, ids=_joined_ids(*ids), deltas=deltas)

    def parts_with(self, rows: list[DataFrame], key: Sequence[str]) -> list[dict]:
        """Parts that may hold one of the keys: by their ids where those are known."""
        parts = self.entry["parts"]
        if list(key) != [_id_of(_schema_of(self.entry), self.name)]:
            return parts
        known = [p for p in parts if p["ids"][0] is not None]
        ids = F.col(key[0])
        ranges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p["ids"][0]).cast("long").alias("low"), F.lit(p["ids"][1]).cast("long").alias("high")) for i, p in enumerate(known)])
        hit: set[int] = set()
        for some in rows if known else []:
            inside = F.explode(F.transform(F.filter(ranges, lambda r: ids.between(r["low"], r["high"])), lambda r: r["i"]))
            hit |= {r["i"] for r in some.select(inside.alias("i")).distinct().collect()}  # at most one row a part
        return [p for i, p in enumerate(known) if i in hit]

    def without_old(self, steps: list[DeleteBefore]) -> _Made:
        """Parts that are old as a whole go unread; those that the limit cuts are written anew without their old rows."""
        gone, kept = set(), []
        schema = _schema_of(self.entry)
        for part in self.entry["parts"]:
            rows = None
            for step in steps:
                limit = self.spark.range(1).select(F.unix_micros(F.lit(step.limit).cast("timestamp"))).first()[0]
                low, high, nulls = part["times"] if step.column == "created_at" and "times" in part else (limit - 1, limit, 0)
                if low is None or low >= limit:
                    continue
                gone.add(part["path"])
                if high < limit and not nulls:
                    rows = None
                    break
                rows = step.after(self.read(part["path"]) if rows is None else rows)
            if rows is not None:
                kept.append(self.written(rows, schema))  # with parts in order of time only one is cut
        return _Made(parts=[p for p in kept if p["rows"]], gone=gone)


# ---------------------------------------------------------------- commits


def _conflict(name: str, made: _Made, base: dict | None, now: dict | None, last_base: int | None, last_now: int | None) -> bool:
    """Whether what others did to a table since `base` forbids to commit a change on top of it."""
    if base == now:
        return False
    if made.entry is not None or base is None or now is None or base["born"] != now["born"]:
        return True
    if made.ids and last_now != last_base and made.ids[1] > (last_base if last_base is not None else made.ids[0] - 1):
        return True  # ids after the last one that the writer knew: given out twice
    if made.cells or made.touched:
        return base["grid"] != now["grid"] or any(base["cells"].get(b) != now["cells"].get(b) for b in made.touched)
    paths = {p["path"] for p in now["parts"]}
    if not made.gone <= paths:
        return True
    keyed = KEYS.get(name) is not None and made.ids is None
    return bool(made.parts) and not made.gone and keyed and {p["path"] for p in base["parts"]} != paths


def _applied(entry: dict | None, made: _Made, version: int) -> dict | None:
    if made.entry is not None:
        return made.entry
    out = {**entry, "cells": dict(entry["cells"])}
    if made.grid is not None:
        out["cells"] = {b: c for b, c in out["cells"].items() if b not in made.touched} | made.cells
        out["grid"] = made.grid
    out["parts"] = [p for p in entry["parts"] if p["path"] not in made.gone] + made.parts
    deltas = [*entry["deltas"], *[{**d, "version": version} for d in made.deltas]]
    lost = [d["version"] for d in deltas[:-FEED_COMMITS]]
    if made.gone and not made.deltas:
        lost.append(version)  # rows went without keys to tell
    out["deltas"], out["feed_after"] = deltas[-FEED_COMMITS:], max([entry["feed_after"], *lost])
    return out


def write_snapshot(
    spark: SparkSession,
    directory: str,
    changes: Mapping[str, Changes],
    stream: str | None = None,
    batch: int | None = None,
    base: int | None = None,
    bucket_rows: int | None = None,
) -> int | None:
    """Commit changes as the next version and return its number; a table that isn't named stays as it is.

    A frame replaces its table, `Append` adds rows, `Upsert` replaces and adds rows by key, `Delete` and `DeleteBefore` remove rows;
    several changes of one table are a sequence. `base` is the version the changes were computed from (that of the tables read;
    the newest by default). If other writers committed since, the changes go on top of theirs, unless they replaced a table, gave out
    the same ids, or rewrote a bucket or part that these changes rewrite: then `VersionTaken` is raised, and the changes
    have to be computed again. With `stream` and `batch` a batch that this very stream has committed already is left alone, and None
    is returned.
    """
    state = manifest(spark, directory, base)
    if stream is not None and manifest(spark, directory)["streams"].get(stream, -1) >= batch:
        return None
    made = {name: _Writer(spark, directory, state, name, bucket_rows or BUCKET_ROWS).made(change) for name, change in changes.items()}
    while True:
        now = manifest(spark, directory)
        if stream is not None and now["streams"].get(stream, -1) >= batch:
            return None
        for name, m in made.items():
            if _conflict(name, m, state["tables"].get(name), now["tables"].get(name), state["last_ids"].get(name), now["last_ids"].get(name)):
                raise VersionTaken(f"{name} has changed since version {state['version']}")
        version = now["version"] + 1
        for name, m in made.items():
            now["tables"][name] = _applied(now["tables"].get(name), m, version)
            if m.entry is not None:
                now["last_ids"].pop(name, None)
            if m.ids:
                now["last_ids"][name] = max(m.ids[1], now["last_ids"].get(name, m.ids[1]))
        if stream is not None:
            now["streams"][stream], now["seen"][stream] = batch, state["version"]
        now["version"] = version
        if _create(spark, _manifest_path(directory, version), json.dumps(now), overwrite=False):
            _create(spark, f"{directory}/{MANIFEST}/newest", str(version), overwrite=True)
            return version


# ---------------------------------------------------------------- reading


def read_snapshot(spark: SparkSession, directory: str, version: int | None = None) -> Tables:
    """The tables of a version, the newest by default."""
    state = manifest(spark, directory, version)

    def source(entry: dict):
        return lambda: _scan(spark, _paths(directory, entry), _schema_of(entry))

    return Tables({name: source(entry) for name, entry in state["tables"].items()}, state["last_ids"], state["version"])


def rows_near(spark: SparkSession, directory: str, name: str, keys: DataFrame, version: int | None = None) -> DataFrame | None:
    """The rows of a bucketed table in the buckets of some keys: all that have one of them, and others. None if there is no such table."""
    entry = manifest(spark, directory, version)["tables"].get(name)
    if entry is None or not entry["key"]:
        return None
    hit = {str(r["b"]) for r in keys.select(_bucket(entry["key"], tuple(entry["grid"])).alias("b")).distinct().collect()}  # at most one row a bucket
    paths = [f"{directory}/{entry['cells'][b]['path']}" for b in sorted(hit & set(entry["cells"]))]
    return _scan(spark, paths, _schema_of(entry))


def changed_rows(spark: SparkSession, directory: str, name: str, since: int, key: Sequence[str], version: int | None = None) -> DataFrame | None:
    """The newest state of the rows that were added or changed after version `since`, from the commits' own files; deleted ones are left out.

    None where that can't be told: the table was written anew, or more than `FEED_COMMITS` changes ago.
    """
    before, entry = manifest(spark, directory, since)["tables"].get(name), manifest(spark, directory, version)["tables"].get(name)
    if before is None or entry is None or before["born"] != entry["born"] or since < entry["feed_after"]:
        return None
    schema, found = _schema_of(entry), None
    for i, delta in enumerate(entry["deltas"]):
        if delta["version"] <= since:
            continue
        rows = _scan(spark, [f"{directory}/{delta['path']}"], StructType([schema[k] for k in key]) if delta["delete"] else schema)
        rows = rows.select(*key, F.lit(i).alias("_at"), F.lit(None).cast(schema).alias("_row") if delta["delete"] else F.struct(*schema.names).alias("_row"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], schema)
    newest = found.groupBy(*key).agg(F.max_by("_row", "_at").alias("_row"))
    return newest.where("_row IS NOT NULL").select("_row.*")


# ---------------------------------------------------------------- upkeep


def compact(spark: SparkSession, directory: str, *names: str) -> int:
    """Commit a version in which each named table that only grows has one folder instead of one for every commit; appends of other
    writers in the meantime stay."""
    state = manifest(spark, directory)
    made = {}
    for name in names:
        parts = state["tables"][name]["parts"]
        if len(parts) > 1:
            writer = _Writer(spark, directory, state, name, BUCKET_ROWS)
            part = writer.written(writer.read(*[p["path"] for p in parts]), _schema_of(writer.entry))
            made[name] = (part, {p["path"] for p in parts})
    while True:
        now = manifest(spark, directory)
        version = now["version"] + 1
        for name, (part, gone) in made.items():
            entry = now["tables"][name]
            if not gone <= {p["path"] for p in entry["parts"]}:
                raise VersionTaken(f"{name} has changed since version {state['version']}")
            entry["parts"] = [part, *[p for p in entry["parts"] if p["path"] not in gone]]
        now["version"] = version
        if _create(spark, _manifest_path(directory, version), json.dumps(now), overwrite=False):
            _create(spark, f"{directory}/{MANIFEST}/newest", str(version), overwrite=True)
            return version


def vacuum(spark: SparkSession, directory: str, keep: int = 8, age_seconds: float = 3600.0) -> int:
    """Delete the folders that none of the newest `keep` versions refers to; returns how many.

    Younger folders stay, since they may belong to a writer that has not committed yet; readers of kept versions are not disturbed.
    """
    newest, used, tables, gone = newest_version(spark, directory), set(), set(), 0
    for version in range(max(0, newest - keep + 1), newest + 1):
        for name, entry in manifest(spark, directory, version)["tables"].items():
            tables.add(name)
            used |= {"/".join(p["path"].split("/")[:2]) for p in [*entry["parts"], *entry["cells"].values(), *entry["deltas"]]}
    limit = (time.time() - age_seconds) * 1000
    for name in tables:
        system, folder = _file(spark, f"{directory}/{name}")
        if not system.exists(folder):
            continue
        for status in system.listStatus(folder):
            if f"{name}/{status.getPath().getName()}" not in used and status.getModificationTime() <= limit:
                system.delete(status.getPath(), True)
                gone += 1
    return gone
