"""Top-k search: both ways of distributing it against brute force, and the edge cases."""

import math

import numpy as np
import pytest
from helpers import T0, agents, bundle
from pyspark.sql import functions as F

import taskloom.operators.search as search
from taskloom.functions.vectors import cosine_similarity, export_vectors, ingest_vectors

CONFIG = [{"config_id": 1, "model_name": "m", "dimensions": 4, "endpoint": "", "is_active": True, "activated_at": T0}]


def brute_force(vectors, query, k):
    def distance(v):
        norm = np.linalg.norm(v) * np.linalg.norm(query)
        return 1 - float(np.dot(v, query)) / norm if norm else math.inf

    return [i for i, _ in sorted(((i, distance(v)) for i, v in vectors.items()), key=lambda p: (round(p[1], 9), p[0]))[:k]]


@pytest.mark.parametrize("broadcast_components", [10**6, 12])
def test_top_k(spark, broadcast_components):
    rng = np.random.default_rng(0)
    # Few distinct vectors, so many candidates tie and the id decides; one zero vector comes last.
    pool = {a: {100 * a + i: rng.integers(-1, 2, 4).astype(float) for i in range(40)} for a in (1, 2)}
    candidates = spark.createDataFrame(
        [(a, i, v.tolist()) for a, items in pool.items() for i, v in items.items()],
        "agent_id long, item_id long, vec array<float>",
    )
    asked = [(q, 1 + q % 3, (rng.integers(-1, 2, 4) + 0.5).tolist()) for q in range(9)]  # agent 3 has no candidates
    queries = spark.createDataFrame(asked, "query_id long, agent_id long, query_vec array<double>")
    hits = search.top_k(candidates, queries, 4, 5, broadcast_components)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {q: brute_force(pool[a], np.array(v), 5) for q, a, v in asked if a in pool}


@pytest.mark.parametrize("broadcast_components", [10**6, 12])
def test_equal_questions_are_answered_once(spark, monkeypatch, broadcast_components):
    """Many queries of few vectors are few questions: they fit into one block, and every query has the whole answer. Rows of one id share its places."""
    rng = np.random.default_rng(2)
    pool = {a: {100 * a + i: rng.standard_normal(4) for i in range(30)} for a in (1, 2)}
    candidates = spark.createDataFrame(
        [(a, i, v.tolist()) for a, items in pool.items() for i, v in items.items()],
        "agent_id long, item_id long, vec array<float>",
    )
    vectors = {a: rng.standard_normal(4) for a in pool}
    asked = [(q, 1 + q % 2, vectors[1 + q % 2].tolist()) for q in range(400)] + [(500, 1, vectors[1].tolist())] * 2 + [(501, a, v.tolist()) for a, v in vectors.items()]
    asked += [(None, 2, vectors[2].tolist())] * 2 + [(502, None, vectors[1].tolist())]
    scanned = []
    scan = search._scan
    monkeypatch.setattr(search, "_scan", lambda c, queries, *more: scanned.append(queries.count()) or scan(c, queries, *more))
    queries = spark.createDataFrame(asked, "query_id long, agent_id long, query_vec array<double>")
    got = {}
    for r in search.top_k(candidates, queries, 4, 5, broadcast_components).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    best = {a: brute_force(pool[a], v, 5) for a, v in vectors.items()}
    assert scanned == [3]  # one of them has no agent
    twice = {a: [i for i in found[:3] for _ in (0, 1)][:5] for a, found in best.items()}
    expected = {q: best[1 + q % 2] for q in range(400)} | {500: twice[1], None: twice[2]}
    assert {q: [i for _, i in found] for q, found in got.items() if q != 501} == expected
    near = sorted((1 - float(v @ vectors[a]) / np.linalg.norm(v) / np.linalg.norm(vectors[a]), i) for a in pool for i, v in pool[a].items())
    assert [i for _, i in got[501]] == [i for _, i in near[:5]]
    assert all([r for r, _ in found] == [1, 2, 3, 4, 5] for found in got.values())


def test_bounds_skip_clusters_and_nothing_else():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 8))
    groups = [(np.arange(50) + 50 * g, c + 0.05 * rng.standard_normal((50, 8))) for g, c in enumerate(centres)]
    groups.append((np.array([9000, 9001]), np.zeros((2, 8))))  # no direction at all
    groups.append((np.array([9002, 9003]), np.array([[1.0] + [0.0] * 7, [-1.0] + [0.0] * 7])))
    queries = np.concatenate([centres[:20] + 0.1 * rng.standard_normal((20, 8)), rng.standard_normal((5, 8))])
    plain, bounded = (search._Best(np.arange(25), queries, 3) for _ in range(2))
    scored = [plain.add(*g) - bounded.add(*g, True) for g in groups]
    assert (np.sort(plain.items, axis=1) == np.sort(bounded.items, axis=1)).all()
    assert sum(scored) > 25 * 1504 / 3  # at least a third was skipped


def test_declared_width_and_missing_model(spark):
    memory = [
        {"memory_id": 1, "agent_id": 1, "content": "a", "embedding": [1.0, 0.0, 0.0, 0.0], "embedding_dims": 4, "created_at": T0},
        {"memory_id": 2, "agent_id": 1, "content": "b", "embedding": [1.0, 0.0], "embedding_dims": 4, "created_at": T0},
        {"memory_id": 3, "agent_id": 1, "content": "c", "embedding": [1.0, 0.0, 0.0, 0.0], "embedding_dims": 2, "created_at": T0},
        {"memory_id": 4, "agent_id": 1, "content": "d", "embedding_dims": 4, "created_at": T0},
    ]
    queries = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0, 0.0])], "query_id long, agent_id long, query_vec array<double>")
    t = bundle(spark, **agents(1), embedding_config=CONFIG, memory=memory)
    assert [r["memory_id"] for r in search.search_memory(t, queries).collect()] == [1]
    off = t.replace(embedding_config=t.embedding_config.withColumn("is_active", F.lit(False)))
    assert search.search_memory(off, queries).isEmpty() and search.search_tools(off, queries).isEmpty()


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and math.isnan(got[1]) and got[2] is None


def test_vector_payloads(spark):
    texts = {
        1: "[1.0,2.5]", 2: '{"embedding":[1,2]}', 3: '{"embedding":[],"vector":[3]}', 4: '{"embedding":0,"data":[4]}',
        5: "[]", 6: '["1"]', 7: "[1,null]", 8: "nope", 9: '{"embedding":"x","vector":[1]}', 10: "5", 11: "[1] x",
    }
    good, bad = ingest_vectors(spark.createDataFrame(list(texts.items()), "item_id long, payload string"))
    assert {r["item_id"]: list(r["embedding"]) for r in good.collect()} == {1: [1.0, 2.5], 2: [1.0, 2.0], 3: [3.0], 4: [4.0]}
    assert sorted(r["item_id"] for r in bad.collect()) == [5, 6, 7, 8, 9, 10, 11]
    assert export_vectors(good.where("item_id = 1")).first()["literal"] == "[1.00000000,2.50000000]"
