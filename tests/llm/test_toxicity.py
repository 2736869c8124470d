import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import toxicity

BAD = ["grublox", "grublent", "zortkin", "zortish"]


def text_of(rng, toxic, n):
    words = ["".join(rng.choice("ka lo mi tu ne sa ri po".split()) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(max(2, n // 25)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def learnt():
    rng = random.Random(1)
    labels = [i % 4 == 0 for i in range(400)]
    return toxicity.fit([text_of(rng, y, rng.randrange(20, 150)) for y in labels], [int(y) for y in labels], steps=150)


def test_windows_cover_every_word():
    for counts in ([0, 1, 48, 49, 80, 81, 500], [0], []):
        starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        codes = np.arange(int(starts[-1]))
        grid, real, owner = toxicity.windows(codes, starts)
        for t, n in enumerate(counts):
            own = [set(g[r].tolist()) for g, r in zip(grid[owner == t], real[owner == t])]
            assert set().union(*own) == set(range(starts[t], starts[t] + n)) if n else not own
            assert all(len(a & b) >= toxicity.WINDOW - toxicity.STRIDE or len(b) < 48 for a, b in zip(own, own[1:]))


def test_gradients_against_differences(learnt):
    rng = np.random.default_rng(3)
    words = pa.array(["kalo", "grublox", "mitu", "unseen", "zortish"])
    known = learnt.features(words)
    codes, real = rng.integers(0, 5, (6, 9)), np.ones((6, 9), bool)
    real[0, 5:] = real[1, 1:] = False
    labels, weights = np.array([0, 1, 0, 1, 1, 0], np.float32), np.full(6, 1 / 6, np.float32)
    net = toxicity.Network(learnt.words, learnt.grams, {k: v.astype(np.float64) for k, v in learnt.p.items()})

    def loss():
        z = net.run(net.gates(net.vectors(known)), codes, real)
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum())

    g = net.gradients(known, net.vectors(known), codes, real, labels, weights)
    for name in ("w", "v", "o", "Uf", "Ub", "Wf", "cb"):
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-3, abs=3e-3)


def test_held_out_accuracy_unseen_forms_and_long_texts(learnt):
    rng = random.Random(9)
    labels = [i % 2 for i in range(200)]
    scores = learnt.scores(pa.array([text_of(rng, y, rng.randrange(20, 400)) for y in labels]))
    assert ((scores >= 0.5) == np.array(labels, bool)).mean() > 0.95
    clean = text_of(rng, False, 6000)
    hidden = clean + " grublox zortish grublox " + text_of(rng, False, 6000)
    assert learnt.scores(pa.array([clean, hidden])).round().tolist() == [0, 1]
    assert learnt.scores(pa.array(["Grublox!! (ZORTISH) kalo grublent."])).round().tolist() == [1]


def test_scores_do_not_depend_on_the_batch(learnt):
    rng = random.Random(4)
    texts = [text_of(rng, i % 3 == 0, 30 * i) for i in range(12)] + ["", None, "???"]
    together = learnt.scores(pa.array(texts), chunk=7)
    alone = [learnt.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    assert np.isfinite(together).all() and (0 <= together).all() and (together <= 1).all()


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_query_rows_and_labels_of_the_held_out_fold(spark, make_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(toxicity, "STEPS", 200)
    rng = random.Random(2)
    docs = [(i, text_of(rng, i % 4 == 0, rng.randrange(20, 80))) for i in range(300)] + [(None if d is None else 1000 + d, t) for d, t in ODD]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    right = [(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)]
    wrong = [(i, q, 1 - t if held(i) and t is not None else t) for i, q, t in right]
    found = [sorted((tuple(r) for r in toxicity.toxic_scores(make_docs(docs), labels_frame(spark, x)).collect()), key=str) for x in (right, wrong)]
    assert found[0] == found[1] and len(found[0]) == len(docs)
    for doc_id, held_out, score, predicted in found[0]:
        assert held_out == (held(doc_id) if doc_id is not None else zlib.crc32(b"") % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    good = [p == int(d % 4 == 0) for d, h, _, p in found[0] if h and d is not None and d < 300]
    assert sum(good) >= 0.9 * len(good)


def test_labels_of_one_kind_or_none(spark, make_docs):  # noqa: F811
    docs = make_docs([(i, f"some text {i}") for i in range(20)] + [(None, None)])
    for labels, expected in (([], None), ([(i, 1, 0) for i in range(20)], 0), ([(i, 1, 1) for i in range(20)], 1)):
        rows = toxicity.toxic_scores(docs, labels_frame(spark, labels)).collect()
        assert len(rows) == 21
        if expected is not None:
            assert {r.predicted for r in rows if r.doc_id is not None} == {expected}
    assert toxicity.toxic_scores(make_docs([]), labels_frame(spark, [])).count() == 0


def test_without_toxic(make_docs, learnt):  # noqa: F811
    rng = random.Random(7)
    docs = make_docs([(i, text_of(rng, i % 2, 60)) for i in range(40)])
    kept = toxicity.without_toxic(docs, learnt)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}


def test_words_are_scored_in_lots(monkeypatch):
    """The n-grams of a batch's words are never held at once; scores don't depend on where lots end."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    network = toxicity.fit([f"{word()} {word()} {'bad' if i % 2 else 'good'} words" for i in range(60)], [i % 2 for i in range(60)], 20)
    texts = pa.array([None, "", *(" ".join(word() for _ in range(rng.randrange(400))) for _ in range(100))])
    whole, most = network.scores(texts), []
    plain_features = network.features
    monkeypatch.setattr(toxicity, "SCORED_WORDS", 512)
    monkeypatch.setattr(toxicity.Network, "features", lambda self, words: most.append(len(words)) or plain_features(words))
    assert np.allclose(network.scores(texts), whole, atol=1e-6)
    assert max(most) == 512 and sum(most) > 15_000
