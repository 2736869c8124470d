"""Exact top-k vector search over memories and granted tools.

Scoring is one matrix product per batch of candidate vectors. Only the best k per query leave a task, so scored pairs are
never materialised as rows, and there are as many scanning tasks as the session works on at a time, not as many as the candidates have
files. Queries go out by broadcast, in blocks of a bounded size; candidates stay where they are, however they are distributed over
agents.

Queries of one agent with equal vectors are one question, however many there are: it is answered once, and its answer is joined with
its queries after the texts are.

Where there is more than one block, the candidates are first dealt once, in clusters of like directions. A cluster is skipped
for the queries that already have k candidates nearer than any of its vectors can be: by the angle to its centre less the
widest angle inside. So the result is exact however well the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Tables
from ..session import passing, scratch_path, stage
from .views import active_dims

DEFAULT_K = 5
# Broadcast at most this many vector components (8 bytes each) of queries at a time.
BROADCAST_COMPONENTS = 4_000_000
# Bits of a cluster's number: the signs of as many random projections.
CLUSTER_BITS = 8

_HITS = "query_id bigint, item_id bigint, distance double"
_UNDEFINED = 4.0  # stands for an undefined distance: after every cosine distance, which is at most 2
_MISSING = np.inf  # stands for "no candidate yet"
_SCORES_AT_ONCE = 4_000_000


class _Best:
    """The best k candidates so far of each query of one agent, kept as two (queries × k) arrays."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int):
        self.query_ids = query_ids
        self.k = k
        self.unit = _unit(vectors)
        self.ranks = np.full((len(query_ids), k), _MISSING)
        self.items = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, items: np.ndarray, vectors: np.ndarray, bounded: bool = False) -> int:
        """Take in candidates, if bounded only for the queries that may gain by it; returns how many pairs were scored."""
        unit = _unit(vectors)
        wanted = np.flatnonzero(self._may_gain(unit)) if bounded else np.arange(len(self.query_ids))
        step = max(1, _SCORES_AT_ONCE // len(items))
        for start in range(0, len(wanted), step):
            self._add(wanted[start : start + step], items, unit)
        return len(wanted) * len(items)

    def _may_gain(self, unit: np.ndarray) -> np.ndarray:
        """Queries whose k-th distance isn't below the least there can be to any of the vectors."""
        worst = self.ranks.max(axis=1)
        centre = unit.sum(axis=0)
        length = np.sqrt(centre @ centre)
        if not np.isfinite(length) or length < 1e-9:
            return np.ones(len(worst), bool)
        centre = centre / length
        width = np.arccos(np.clip((unit @ centre).min(), -1, 1))
        angle = np.arccos(np.clip(self.unit @ centre, -1, 1))
        least = 1 - np.cos(np.maximum(angle - width, 0))
        return ~(worst < least - 1e-9)

    def _add(self, part: np.ndarray, items: np.ndarray, unit: np.ndarray) -> None:
        k = self.k
        scores = 1.0 - self.unit[part] @ unit.T
        ranks = np.hstack([self.ranks[part], np.where(np.isnan(scores), _UNDEFINED, scores)])
        ids = np.hstack([self.items[part], np.broadcast_to(items, scores.shape)])
        limit = np.partition(ranks, k - 1, axis=1)[:, k - 1 : k]
        chosen = np.argpartition(ranks, k - 1, axis=1)[:, :k]
        # Ties on the limit are decided by id, so rows that have more candidates on it than places are sorted in full.
        for row in np.flatnonzero((ranks <= limit).sum(axis=1) > k):
            within = np.flatnonzero(ranks[row] <= limit[row])
            chosen[row] = within[np.lexsort((ids[row, within], ranks[row, within]))[:k]]
        self.ranks[part] = np.take_along_axis(ranks, chosen, axis=1)
        self.items[part] = np.take_along_axis(ids, chosen, axis=1)

    def rows(self) -> pd.DataFrame:
        found = self.ranks < _MISSING
        ranks = self.ranks[found]
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, found.sum(axis=1)),
                "item_id": self.items[found],
                "distance": np.where(ranks == _UNDEFINED, np.nan, ranks),
            }
        )


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN, as its cosine is undefined."""
    vectors = vectors.astype(np.float64)
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / lengths


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scan(candidates: DataFrame, queries: DataFrame, width: int, k: int, clustered: bool) -> DataFrame:
    """The best k of every query within each task; `queries` are few enough to go out by broadcast."""
    spark = candidates.sparkSession
    rows = queries.toPandas()
    by_agent = {
        agent: (part["query_id"].to_numpy(np.int64), np.array(part["query_vec"].tolist()).reshape(-1, width))
        for agent, part in rows.groupby("agent_id")
    }
    shared = spark.sparkContext.broadcast(by_agent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {agent: _Best(ids, vectors, k) for agent, (ids, vectors) in shared.value.items()}
        for batch in batches:
            agents = batch.column("agent_id").to_numpy(zero_copy_only=False)
            items = batch.column("item_id").to_numpy(zero_copy_only=False)
            groups = batch.column("cluster").to_numpy(zero_copy_only=False) if clustered else np.zeros(len(agents), np.int64)
            vectors = _matrix(batch.column("vec"), width)
            for agent, group in np.unique(np.stack([agents, groups]), axis=1).T.tolist():
                if agent in best:
                    here = (agents == agent) & (groups == group)
                    best[agent].add(items[here], vectors[here], clustered)
        for found in best.values():
            yield pa.RecordBatch.from_pandas(found.rows(), preserve_index=False)

    # The agents asked about are at most as many as the queries just counted.
    asked = F.broadcast(queries.select("agent_id").distinct())
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return candidates.join(asked, "agent_id", "left_semi").coalesce(tasks).mapInArrow(scan, _HITS)


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _clusters(candidates: DataFrame, width: int) -> DataFrame:
    """The candidates with the number of their cluster, dealt and ordered by it, written once."""
    projections = np.random.default_rng(5).standard_normal((CLUSTER_BITS, width))
    signs = [
        (F.aggregate(F.zip_with("vec", F.lit([float(x) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) > 0).cast("int") * (1 << i)
        for i, row in enumerate(projections)
    ]
    numbered = candidates.withColumn("cluster", sum(signs[1:], signs[0]))
    # A salt of the item keeps a cluster that holds most candidates from being one task's.
    dealt = numbered.repartition("agent_id", "cluster", F.pmod(F.xxhash64("item_id"), F.lit(16)))
    return stage(dealt.sortWithinPartitions("agent_id", "cluster"))


def top_k(
    candidates: DataFrame, queries: DataFrame, width: int, k: int, broadcast_components: int = BROADCAST_COMPONENTS
) -> DataFrame:
    """(query_id, item_id, distance, rank) of the k nearest candidates of each query's agent.

    candidates: (agent_id, item_id, vec), queries: (query_id, agent_id, query_vec), all vectors of the given width. Rows of one
    query_id share its k places.
    """
    asked, hits = _answered(candidates, queries, width, k, broadcast_components)
    return asked.join(hits, "answer").select("query_id", "item_id", "distance", "rank")


def _answered(
    candidates: DataFrame, queries: DataFrame, width: int, k: int, broadcast_components: int
) -> tuple[DataFrame, DataFrame]:
    """Which answer every query has (query_id, answer), and the answers (answer, item_id, distance, rank)."""
    asked = stage(queries)
    numbered = asked.select("agent_id", "query_vec").distinct().withColumn("question", F.monotonically_increasing_id())
    questions = stage(numbered)
    asking = asked.join(questions, ["agent_id", "query_vec"]).select("query_id", "question")
    # An id of one row has the answer of its question, an id of several rows one of its own, below 0.
    ids = asking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("question").alias("question"))
    counted = stage(ids.withColumn("nth", F.monotonically_increasing_id()))
    answer = F.when(F.col("n") == 1, F.col("question")).otherwise(-1 - F.col("nth"))
    of_query = counted.select("query_id", answer.alias("answer"))
    hits = _hits(candidates, questions.withColumnRenamed("question", "query_id"), width, k, broadcast_components)
    own = of_query.where("answer < 0").withColumnRenamed("query_id", "own_id")
    several = asking.join(own, F.col("query_id").eqNullSafe(F.col("own_id"))).select("answer", "question")
    shared = several.join(hits.drop("rank").withColumnRenamed("query_id", "question"), "question").drop("question")
    ranked = _nearest(shared.withColumnRenamed("answer", "query_id"), k)
    return of_query, hits.unionByName(ranked).withColumnRenamed("query_id", "answer")


def _hits(candidates: DataFrame, queries: DataFrame, width: int, k: int, broadcast_components: int) -> DataFrame:
    """The k nearest candidates of queries with an id each, written. Queries beyond `broadcast_components` are answered block by block,
    each in a job of its own."""
    few = max(1, broadcast_components // width)
    n = queries.count()
    if n <= few:
        return stage(_nearest(_scan(candidates, queries, width, k, False), k))
    blocks = -(-2 * n // few)  # half full on average, since a hash deals them
    asked = stage(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block"))
    asked_of = candidates.join(asked.select("agent_id").distinct(), "agent_id", "left_semi").select("agent_id", "item_id", "vec")
    near = _clusters(asked_of, width)
    spark, path = candidates.sparkSession, scratch_path(candidates.sparkSession, "hits")
    schema = f"{_HITS}, rank int"
    for block in range(blocks):
        found = _nearest(_scan(near, asked.where(F.col("block") == block).drop("block"), width, k, True), k)
        found.write.mode("append").parquet(path)
    passing(path)
    return spark.read.schema(schema).parquet(path)


def _width(t: Tables) -> int | None:
    """Width of the active model: the one value the search reads on the driver."""
    return active_dims(t).first()["dimensions"]


def _searchable(vector: str, width: int) -> Column:
    """Vectors of the active width. A vector whose real length differs from the declared one is left out."""
    return (F.col("embedding_dims") == width) & (F.size(vector) == width)


def _asked(queries: DataFrame, width: int) -> DataFrame:
    return queries.where(F.col("query_vec").isNotNull() & (F.size("query_vec") == width)).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("agent_id").cast("long").alias("agent_id"), "query_vec"
    )


def _empty(queries: DataFrame, schema: str) -> DataFrame:
    return queries.sparkSession.createDataFrame([], schema)


def search_memory(t: Tables, queries: DataFrame, k: int = DEFAULT_K, broadcast_components: int = BROADCAST_COMPONENTS) -> DataFrame:
    """The k memories of the query's agent nearest to each query (query_id, agent_id, query_vec)."""
    width = _width(t)
    if width is None:
        return _empty(
            queries, "query_id bigint, rank int, memory_id bigint, content string, similarity double, created_at timestamp"
        )
    pool = t.memory.where(_searchable("embedding", width)).select(
        "agent_id", F.col("memory_id").alias("item_id"), F.col("embedding").alias("vec")
    )
    asked, hits = _answered(pool, _asked(queries, width), width, k, broadcast_components)
    texts = t.memory.select("memory_id", "content", "created_at")
    found = hits.withColumnRenamed("item_id", "memory_id").join(texts, "memory_id")
    return asked.join(found, "answer").select(
        "query_id", "rank", "memory_id", "content", (F.lit(1.0) - F.col("distance")).alias("similarity"), "created_at"
    )


def search_tools(t: Tables, queries: DataFrame, k: int = DEFAULT_K, broadcast_components: int = BROADCAST_COMPONENTS) -> DataFrame:
    """As `search_memory` over the active tools granted to the query's agent."""
    width = _width(t)
    if width is None:
        return _empty(
            queries,
            "query_id bigint, rank int, tool_id bigint, name string, description string, input_schema string, "
            "tool_type string, similarity double",
        )
    asked = _asked(queries, width)
    tools = t.tool_registry.where("is_active")
    vectors = tools.where(_searchable("description_embedding", width)).select(
        "tool_id", F.col("description_embedding").alias("vec")
    )
    grants = t.agent_tool_permissions.join(asked.select("agent_id").distinct(), "agent_id", "left_semi")
    pool = grants.join(vectors, "tool_id").select("agent_id", F.col("tool_id").alias("item_id"), "vec")
    of_query, hits = _answered(pool, asked, width, k, broadcast_components)
    texts = tools.select("tool_id", "name", "description", "input_schema", "tool_type")
    found = hits.withColumnRenamed("item_id", "tool_id").join(texts, "tool_id")
    return of_query.join(found, "answer").select(
        "query_id", "rank", "tool_id", "name", "description", "input_schema", "tool_type",
        (F.lit(1.0) - F.col("distance")).alias("similarity"),
    )
