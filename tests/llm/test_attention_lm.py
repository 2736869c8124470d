import math
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import attention_lm as lm
from taskloom.llm import subwords

PATH = subwords.vocabulary_path("byte_bpe_50k.tiktoken")


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def stream(text):
    encoding = subwords.rank_encoding(PATH, lm.VOCABULARY)
    return [i for w in words_of(text) for i in encoding.encode_ordinary(" " + w)] + [lm.END]


def brute_score(flat, ids):
    """Every subword on its own, from the definition."""
    p, total = {k: v.astype(np.float64) for k, v in lm.named(flat).items()}, 0.0
    for t, y in enumerate(ids):
        first = t - t % lm.NEW - 1 - lm.CONTEXT
        seen = [ids[i] if i >= 0 else lm.START for i in range(first, t)]
        x = p["emb"][seen] + p["pos"][: len(seen)]
        q, k, v = x[-1] @ p["q"], x @ p["k"], x @ p["v"]
        a = np.exp(k @ q)
        h = x[-1] + (a / a.sum()) @ v @ p["o"]
        h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        group, member = y % lm.GROUPS, y // lm.GROUPS
        g, m = h @ p["g"] + p["gb"], h @ p["m"][group] + p["mb"][group]
        total += g[group] - np.log(np.exp(g).sum()) + m[member] - np.log(np.exp(m).sum())
    return total / math.log(10)


TEXTS = [t for _, t in ODD if t is None or len(t) < 2000] + ["word " * 40, "A B c"]


def test_subwords_of_a_batch():
    words = lm.Words(pa.array(TEXTS, pa.string()))
    ids, starts = words.subwords(lm._encoder(PATH))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [stream(t) for t in TEXTS]
    some, at = words.subwords(lm._encoder(PATH), slice(3, 5))
    assert [some[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [stream(t) for t in TEXTS[3:5]]


def test_windows_score_every_subword_once_as_defined():
    flat = lm.fresh() * 2
    words = lm.Words(pa.array(TEXTS, pa.string()))
    ids, starts = words.subwords(lm._encoder(PATH))
    inputs, targets, real, text = lm.windows(ids, starts)
    assert real.sum() == len(ids) and targets[real].tolist() == ids.tolist()
    logs = np.where(real, lm.log_probabilities(flat, inputs, targets, chunk=5), 0).sum(axis=1)
    found = np.bincount(text, weights=logs, minlength=len(TEXTS)) / math.log(10)
    assert np.allclose(found, [brute_score(flat, stream(t)) for t in TEXTS], rtol=1e-4)


def test_probabilities_sum_to_one():
    flat = lm.fresh(1)
    inputs = np.random.default_rng(1).integers(0, lm.VOCABULARY + 2, (1, lm._LENGTH))
    every = np.arange(lm.GROUPS * lm.EACH)
    targets = np.zeros((len(every), lm.NEW), np.int64)
    targets[:, 5] = every
    logs = lm.log_probabilities(flat, np.repeat(inputs, len(every), axis=0), targets)
    assert np.exp(logs[:, 5].astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    assert lm.END == len(every) - 1


def test_no_target_sees_itself_or_what_follows():
    flat = lm.fresh(2)
    rng = np.random.default_rng(2)
    a = rng.integers(0, lm.VOCABULARY, (1, lm._LENGTH))
    b = a.copy()
    b[0, lm.CONTEXT + 7 :] = rng.integers(0, lm.VOCABULARY, lm._LENGTH - lm.CONTEXT - 7)
    t = rng.integers(0, lm.VOCABULARY, (1, lm.NEW))
    assert np.allclose(lm.log_probabilities(flat, a, t)[0, :7], lm.log_probabilities(flat, b, t)[0, :7], atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    flat = lm.fresh(3).astype(np.float64)
    inputs, targets = rng.integers(0, 512, (3, lm._LENGTH)), rng.integers(0, 512, (3, lm.NEW))
    real = np.ones(targets.shape, bool)
    real[1, 4:] = False
    grad = lm._gradient(flat, inputs, targets, real)
    loss = lambda f: -(lm.log_probabilities(f, inputs, targets).astype(np.float64) * real).sum() / real.sum()
    at = 0
    for name in lm._SHAPES:
        own = np.arange(at, at + lm._SIZES[name])
        at += lm._SIZES[name]
        i = own[np.argmax(np.abs(grad[own]))]
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05, abs=2e-4), name


def brute_base(docs, held):
    train = [t for d, t in docs if not held(d)]
    counts = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [0, 3, 10_000])
def test_baseline_and_model_of_odd_documents(make_docs, monkeypatch, frequent):  # noqa: F811
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = [(d, t if t is None or len(t) < 2000 else t[:1500]) for d, t in ODD] + [(50 + i, f"common words and w{i % 7} again common") for i in range(30)]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    flat = lm.fresh()
    fold = lm.crc_mod("doc_id", 5) == 1
    rows = lm.scores(make_docs(docs), fold, parameters=flat).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=str) == brute_base(docs, held)
    expected = sorted(round(brute_score(flat, stream(t)), 2) for _, t in docs)
    assert np.allclose(sorted(r.score for r in rows), expected, rtol=1e-3, atol=0.02)


def test_training_beats_the_untrained_and_knows_order(make_docs, monkeypatch):  # noqa: F811
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the cat", "sat on", "a mat", "and then"]) for _ in range(60))
    docs = make_docs([(i, text()) for i in range(120)])
    flat = lm.train(docs, PATH, rate=8, rounds=2, steps=60, shard=256)
    held = [stream(text()) for _ in range(5)]
    assert sum(brute_score(flat, h) for h in held) > 0.4 * sum(brute_score(lm.fresh(), h) for h in held)
    assert brute_score(flat, stream("the cat sat on a mat")) > brute_score(flat, stream("cat the on sat mat a"))


def test_sample_grows_with_the_corpus(make_docs):  # noqa: F811
    rng = random.Random(5)
    few = [(i, " ".join(str(rng.random()) for _ in range(80))) for i in range(60)]
    sizes = [lm.training_windows(make_docs(d), PATH, 16).count() for d in (few, few + [(i, t[::-1]) for i, t in few] * 3)]
    assert sizes[0] > 20 and sizes[1] > 3 * sizes[0]


@pytest.mark.parametrize("times", [1, 40])
def test_copies_neither_fill_a_shard_nor_outweigh(make_docs, monkeypatch, times):  # noqa: F811
    """One text many times over is learnt once; the rate is the same for every size."""
    rng = random.Random(6)
    other = [(i, " ".join(str(rng.random()) for _ in range(60))) for i in range(40)]
    sizes, rates = [], []
    plain_windows = lm.training_windows
    monkeypatch.setattr(lm, "training_windows", lambda d, p, rate, c: rates.append(rate) or plain_windows(d, p, rate, c))
    monkeypatch.setattr(lm, "staged", lambda df, label: sizes.append(df.count()) or df.cache())
    copied = " ".join(str(rng.random()) for _ in range(200))
    lm.train(make_docs(other + [(100 + i, copied) for i in range(times)]), PATH, rate=4, rounds=1, steps=1, shard=64)
    once = plain_windows(make_docs([*other, (100, copied)]), PATH, 4).select("ids").distinct().count()
    assert rates == [4] and sizes[0] == sizes[1] == once


def test_windows_are_packed_and_unpacked():
    ids, starts = lm.Words(pa.array(TEXTS, pa.string())).subwords(lm._encoder(PATH))
    inputs, targets, real, _ = lm.windows(ids, starts)
    rows = lm.packed(inputs, targets, real)
    assert rows.shape == (len(inputs), lm._PACKED) and rows.dtype == np.uint8 and lm.START < lm._PAST
    some, goals, there = lm.unpacked(rows)
    assert (there == real).all() and (goals[real] == targets[real]).all() and (some[:, : lm.CONTEXT + 1] == inputs[:, : lm.CONTEXT + 1]).all()


def test_every_window_teaches(make_docs, monkeypatch):  # noqa: F811
    """By default all windows of all texts are dealt, each to one shard of one round, and a shard is gone through whole."""
    rng = random.Random(7)
    texts = [" ".join(str(rng.random()) for _ in range(rng.randrange(60))) for _ in range(50)]
    ids, starts = lm.Words(pa.array(texts)).subwords(lm._encoder(PATH))
    inputs, targets, real, _ = lm.windows(ids, starts)
    every = {(tuple(i[: lm.CONTEXT + 1]), tuple(t[r])) for i, t, r in zip(inputs.tolist(), targets, real)}
    dealt = []
    monkeypatch.setattr(lm, "staged", lambda df, label: dealt.append(df.collect()) or df.cache())
    lm.train(make_docs(list(enumerate(texts))), PATH, steps=1, shard=100)
    shards = {}
    for row in dealt[1]:
        shards.setdefault(row.shard, []).append(bytes(row.ids))
    assert len(every) > 900 and len(shards) > lm.ROUNDS

    met = []
    monkeypatch.setattr(lm, "BATCH", 32)
    monkeypatch.setattr(lm, "_gradient", lambda flat, i, t, r: met.extend(zip(i, t, r)) or flat * 0)
    for number in range(max(shards) + 1):
        before = len(met)
        lm._local_round(SimpleNamespace(value=lm.fresh()), 0, 1)(pd.DataFrame({"ids": shards[number]}))
        assert len(met) - before >= len(shards[number])
    assert {(tuple(i[: lm.CONTEXT + 1].tolist()), tuple(t[r])) for i, t, r in met} == every


def test_nothing_to_learn_from(make_docs):  # noqa: F811
    assert lm.corpus_scores(make_docs([])).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = lm.corpus_scores(make_docs([(i, "two words") for i in held])).collect()
    assert len(rows) == 2 and all((r.n_known, r.train_tokens) == (0, 0) and r.base_score == pytest.approx(0) and r.score < 0 for r in rows)


@pytest.mark.parametrize("windows", [64, 512])
def test_arrays_are_taken_again_for_the_next_windows(windows):
    """What a batch needs beside the arrays of the batch before is less than a sixth of them."""
    rng = np.random.default_rng(8)
    flat, inputs, targets = lm.fresh(8), rng.integers(0, 512, (windows, lm._LENGTH)), rng.integers(0, 512, (windows, lm.NEW))
    real = np.ones(targets.shape, bool)
    real[3, 5:] = False
    hidden = 4 * windows * (lm._LENGTH * 5 * lm.DIM + lm.NEW * (2 * lm._LENGTH + 6 * lm.DIM + 2 * lm.INNER + 2 * lm.GROUPS + 2 * lm.EACH))
    for work in (lambda: lm._gradient(flat, inputs, targets, real), lambda: lm.log_probabilities(flat, inputs, targets)):
        before = work()
        tracemalloc.start()
        assert np.array_equal(work(), before)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < hidden / 6
    some = lm._gradient(flat, inputs[:7], targets[:7], real[:7])  # fewer windows in the same arrays, and none that are real
    assert np.allclose(some, lm._gradient(flat.astype(np.float64), inputs[:7], targets[:7], real[:7]), atol=1e-5)
    assert not lm._gradient(flat, inputs[:7], targets[:7], real[:7] & False).any()


@pytest.mark.parametrize("rows", [0, 1, 63, 64, 200])
def test_rows_are_added_and_logits_clipped(rows):
    """Loops over long rows give the same bits as the plain ones; only logits above 60 are clipped, and what is no number stays."""
    rng = np.random.default_rng(9)
    x, row = rng.standard_normal((rows, 24)).astype(np.float32), rng.standard_normal(24).astype(np.float32)
    expected = x + row
    lm._add_row(x, row)
    assert np.array_equal(x, expected)
    for most in (50, 70, np.nan):
        logits = expected.copy()
        logits[rows // 2 : rows // 2 + 1, 3] = most
        clipped = np.exp(np.minimum(logits, 60))
        sums = lm._exp(logits)
        assert np.array_equal(logits, clipped, equal_nan=True) and np.array_equal(sums, clipped @ np.ones(24, np.float32), equal_nan=True)
    assert not lm._zeros(np.dtype(np.float32), rows).any()


def test_chunks_are_encoded_in_one_string(monkeypatch):
    """Chunks that no white space parts from their neighbours are strings of their own, all others one together; no chunk is remembered."""
    encoding = subwords.rank_encoding(PATH, lm.VOCABULARY)
    encoder = subwords.rank_encoder(PATH, lm.VOCABULARY)
    chunks = [" the", "", " ", " a b", " x", " don't", " café", " 你好", " 12ab!?", " \x85", " q\x1cr", " the", " \U0001f600", "no space", " it's　", " zz" * 3]
    strings = []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: strings.append(len(texts)) or whole(texts))
    for lot in (chunks, chunks[::-1], [" one", " two"], ["", "x"], []):
        ids, sizes = encoder.pooled(pa.array(["?", *lot], pa.string())[1:])
        ends = np.cumsum(sizes)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == [encoding.encode_ordinary(c) for c in lot] and ids.dtype == np.uint16
    assert strings.count(1) >= 3 and not encoder.known
