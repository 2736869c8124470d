"""Toxicity by a bidirectional gated recurrent network with attention pooling over windows of words.

A word enters as the sum of two vectors: one for the word itself, if the training sample holds it in several documents, and the mean
over its character n-grams known from there, so that unseen forms of known stems count. Windows of `WINDOW` words, one every
`STRIDE`, cover the whole text; forward and backward gated recurrent units run over each, attention weights their states,
and a document's score is that of its highest window.

The network is trained in numpy, in one task, on whole texts of a bounded sample of labelled rows. A document's label holds for its highest
window (a toxic document needs one toxic window, a clean one has none), so each step learns from the window that scores highest at
that time. Words and n-grams start from how far their documents' labels depart from chance, change slowly, decay, and are left out at random, so
that rare words aren't learnt by heart; a fifth of the sample is kept back, the parameters of its least loss are the result, and it sets the threshold. Tasks
get the parameters by broadcast; their size is fixed by the bounds below.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod

WINDOW = 48
STRIDE = 32
#: Labelled documents to learn from: at most so many of either label, and whole documents of so many words together.
SAMPLE_TOXIC = 1200
SAMPLE_CLEAN = 2400
SAMPLE_WORDS = 2_000_000
MAX_WORDS = 1 << 14
MAX_GRAMS = 1 << 16
GRAMS = (4, 5)
DIM = 8
HIDDEN = 8
#: Steps at most; every `LOOK` steps the loss on what is kept back is looked at, and `PATIENCE` looks without a better one end it.
STEPS = 400
LOOK = 20
PATIENCE = 5
#: Share of words left out of a step, their decay and their learning rate beside that of the rest, and the weight of their start.
DROP = 0.3
DECAY = 0.1
WORD_RATE = 0.05
START = 2.0
#: Clean and toxic documents of a step.
BATCH = (56, 20)
SLOTS = 1 << 20
#: Distinct words whose n-grams are held at a time when texts are scored.
SCORED_WORDS = 1 << 14
_TRIM = " .,;:!?\"'()[]{}<>|*#$%&+-=/\\_~`^0123456789"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of every word of all texts, where each text's words start and the last end)."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(lists.flatten())
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Forms that differ in the marks around them are one word; what has nothing else drops out.
    trimmed = pc.dictionary_encode(pc.utf8_trim(flat.dictionary, _TRIM))
    codes = trimmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    filled = pc.not_equal(trimmed.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    starts = np.concatenate(([0], np.cumsum(counts)))
    kept = np.concatenate(([0], np.cumsum(filled)))
    return trimmed.dictionary, codes[filled], kept[starts]


def _hashes(words: pa.Array, slice_words: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, hashes of its n-grams, the n-grams' words), made in slices of the words."""
    whole, grams, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for low in range(0, len(words), slice_words):
        w, g, o = _hashes_of(words.slice(low, slice_words))
        whole.append(w)
        grams += g
        of += [x + np.int32(low) for x in o]
    return np.concatenate(whole), np.concatenate(grams), np.concatenate(of)


def _hashes_of(words: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    marked = pc.binary_join_element_wise("^", words, "$", "").cast(pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(marked.buffers()[2], np.uint8)[low:high].astype(np.uint64) + np.uint64(1)
    starts, ends = offsets[:-1] - low, offsets[1:] - low
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), ends - starts)
    place = np.arange(len(data)) - starts[owner]
    whole = _mixed(np.add.reduceat(_mixed(data * _POWERS[place % 64] + place.astype(np.uint64)), starts))
    grams, of = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[j : len(data) - n + 1 + j]
        inside = np.flatnonzero(np.arange(len(h)) + n <= ends[owner[: len(h)]])
        grams.append(_mixed(h[inside] + np.uint64(n)))
        of.append(owner[inside])
    return whole, grams, of


class Known:
    """A set of hashes with numbers from 1, looked up in one step; 0 for others."""

    def __init__(self, hashes: np.ndarray):
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        _, first = np.unique(slots, return_index=True)  # of two hashes in a slot the first, more frequent one stays
        first.sort()
        self.hashes = hashes[first]
        self.keys = np.zeros(SLOTS, np.uint32)
        self.numbers = np.zeros(SLOTS, np.int32)
        self.keys[slots[first]] = (self.hashes >> np.uint64(32)).astype(np.uint32)
        self.numbers[slots[first]] = np.arange(1, len(first) + 1)

    def __len__(self) -> int:
        return len(self.hashes)

    def __reduce__(self):
        return Known, (self.hashes,)  # the table is made anew

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        return np.where(self.keys[slots] == (hashes >> np.uint64(32)).astype(np.uint32), self.numbers[slots], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name; `words` and `grams` number the known words and n-grams."""

    words: Known
    grams: Known
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(words: Known, grams: Known, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
        p = {"word": normal(len(words) + 1, DIM, by=0.02), "gram": normal(len(grams) + 1, DIM, by=0.02)}
        p["word"][0] = p["gram"][0] = 0
        for d in ("f", "b"):
            p |= {"W" + d: normal(2 * DIM, 3 * HIDDEN), "U" + d: normal(HIDDEN, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, np.float32)}
        return Network(words, grams, p | {"v": normal(2 * HIDDEN), "w": normal(2 * HIDDEN), "o": np.float32([-1.0])})

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, known_words=self.words.hashes, known_grams=self.grams.hashes, **self.p)
        return file.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Network:
        p = dict(np.load(io.BytesIO(data)))
        return Network(Known(p.pop("known_words")), Known(p.pop("known_grams")), p)

    def features(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of every word, numbers of its known n-grams, the n-grams' words)."""
        whole, grams, of = _hashes(words)
        found = self.grams.find(grams)
        hit = found > 0
        return self.words.find(whole), found[hit], of[hit]

    def vectors(self, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Word vector beside the mean n-gram vector, for every word."""
        numbers, grams, of = known
        n = len(numbers)
        chars = np.zeros((n, DIM), np.float32)
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
        for low in range(0, len(grams), 1 << 18):  # n-grams in slices; a word may lie across two
            part = of[low : low + (1 << 18)]
            begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            chars[part[begins]] += np.add.reduceat(self.p["gram"][grams[low : low + (1 << 18)]], begins, axis=0)
        chars /= np.maximum(np.bincount(of, minlength=n), 1)[:, None]
        return np.concatenate([self.p["word"][numbers], chars], axis=1)

    def run(self, gates: dict[str, np.ndarray], codes: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; `gates` holds each word's input to the gates, `codes` the windows' words, `real` what isn't filling."""
        n, steps = codes.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        for d, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p["U" + d]
            for t in order:
                x = gates[d][codes[:, t]]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN] * real[:, t : t + 1], zr[:, HIDDEN:]
                rh = r * h
                c = np.tanh(x[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
                if keep:
                    kept[d].append((t, h, z, r, rh, c))
                h = h + z * (c - h)
                states[t, :, part] = h
        a = states @ self.p["v"] + np.where(real.T, 0, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["w"] + self.p["o"][0]
        return (logits, states, a, pooled, kept) if keep else logits

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p["W" + d] + self.p["c" + d] for d in ("f", "b")}

    def gradients(self, known, x, codes, real, labels, weights) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy over windows."""
        p = self.p
        logits, states, a, pooled, kept = self.run(self.gates(x), codes, real, keep=True)
        d_logit = ((_sigmoid(logits) - labels) * weights).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["o"] = pooled.T @ d_logit, np.float32([d_logit.sum()])
        d_pooled = d_logit[:, None] * p["w"]
        d_states = a[:, :, None] * d_pooled
        d_a = (states * d_pooled).sum(axis=2)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        d_states += d_score[:, :, None] * p["v"]
        g["v"] = np.einsum("tnk,tn->k", states, d_score)
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, d_h = p["U" + d], np.zeros((len(codes), HIDDEN), np.float32)
            d_gate = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, rh, c in reversed(kept[d]):
                d_h = d_h + d_states[t, :, part]
                d_z = d_h * (c - h) * z * (1 - z)
                d_c = d_h * z * (1 - c * c)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_in = np.concatenate([d_z * real[:, t : t + 1], d_r, d_c], axis=1)
                g["U" + d][:, : 2 * HIDDEN] += h.T @ d_in[:, : 2 * HIDDEN]
                g["U" + d][:, 2 * HIDDEN :] += rh.T @ d_c
                np.add.at(d_gate, codes[:, t], d_in)
                d_h = d_h * (1 - z) + d_rh * r + d_in[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
            g["W" + d], g["c" + d] = x.T @ d_gate, d_gate.sum(axis=0)
            d_x += d_gate @ p["W" + d].T
        numbers, grams, of = known
        size = np.maximum(np.bincount(of, minlength=len(x)), 1)
        for k in range(DIM):
            g["word"][:, k] = np.bincount(numbers, weights=d_x[:, k], minlength=len(p["word"]))
            g["gram"][:, k] = np.bincount(grams, weights=(d_x[:, DIM + k] / size)[of], minlength=len(p["gram"]))
        g["word"][0] = g["gram"][0] = 0
        return g

    def scores(self, texts: pa.Array, chunk: int = 1024) -> np.ndarray:
        """Score of every text: of its highest window; that of no words for empty texts."""
        words, codes, starts = words_of(texts)
        lots = [self.gates(self.vectors(self.features(words.slice(low, SCORED_WORDS)))) for low in range(0, max(1, len(words)), SCORED_WORDS)]
        gates = {d: np.concatenate([g[d] for g in lots]) for d in ("f", "b")}
        del lots, words
        grid, real, owner = windows(codes, starts)
        out = np.full(len(texts), self.p["o"][0], np.float32)
        best = np.full(len(texts), -np.inf, np.float32)
        for low in range(0, len(grid), chunk):
            part = slice(low, low + chunk)
            np.maximum.at(best, owner[part], self.run(gates, grid[part], real[part]))
        return _sigmoid(np.where(np.isfinite(best), best, out).astype(np.float64))


def windows(codes: np.ndarray, starts: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, what isn't filling, text) of all overlapping windows; a text of at most `size` words is one, of none has none."""
    counts = np.diff(starts)
    per_text = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - size) // stride)), 0)
    owner = np.repeat(np.arange(len(counts)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = starts[owner][:, None] + nth[:, None] * stride + np.arange(size)
    real = at < starts[owner + 1][:, None] if len(owner) else np.zeros((0, size), bool)
    grid = codes[np.minimum(at, max(0, len(codes) - 1))] if len(codes) else np.zeros((0, size), np.int64)
    return grid, real, owner


def _frequent(hashes: np.ndarray, weights: np.ndarray, documents: int, most: int) -> np.ndarray:
    """Hashes whose weights, documents of the words that have them, sum up to three at least (or to all, in a tiny sample), the heaviest
    first."""
    distinct, number = np.unique(hashes, return_inverse=True)
    counts = np.bincount(number, weights=weights, minlength=len(distinct))
    keep = np.flatnonzero(counts >= min(3, documents))
    return distinct[keep[np.argsort(-counts[keep], kind="stable")]][:most]


def _departure(number: np.ndarray, size: int, documents: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How far the toxic documents of each known word or n-gram depart from their share, in deviations; small ones count as none."""
    total = np.bincount(number, weights=documents, minlength=size)
    seen = np.bincount(number, weights=toxic, minlength=size)
    z = (seen - total * share) / np.sqrt(total * share + 1)
    return np.sign(z) * np.tanh(np.maximum(np.abs(z) - 2.5, 0) / 4)


def _threshold(z: np.ndarray, y: np.ndarray) -> np.float32:
    """The logit that parts the labels best, a false alarm counting twice; of the widest gap that does three quarters up, since longer
    texts have more windows to give a false alarm."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.concatenate(([0], np.cumsum(y))) / y.sum()
    alarms = np.concatenate(([0], np.cumsum(y == 0)))
    cost = missed + 2 * (1 - alarms / alarms[-1])
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gaps = np.where(cost <= cost.min() + 1e-9, np.diff(edges), -1)
    at = int(np.argmax(gaps))
    return np.float32(edges[at] + 0.75 * (edges[at + 1] - edges[at]))


def fit(texts: list[str], labels: list[int], steps: int | None = None, seed: int = 7) -> Network:
    """A network learnt from texts and their labels, 0 or 1, in at most `steps` steps."""
    steps = STEPS if steps is None else steps
    words, codes, starts = words_of(pa.array(texts, pa.string()))
    whole, grams, of = _hashes(words)
    y = np.array(labels, np.float32)
    back = np.arange(len(texts)) % 5 == 4  # kept back
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    pairs = np.unique(owner * max(1, len(words)) + codes) if len(codes) else np.zeros(0, np.int64)
    documents = np.bincount(pairs % max(1, len(words)), minlength=len(words))
    learnt = pairs[~back[pairs // max(1, len(words))]] if len(pairs) else pairs
    in_learnt, own = learnt % max(1, len(words)), learnt // max(1, len(words))
    seen, toxic = np.bincount(in_learnt, minlength=len(words)), np.bincount(in_learnt, weights=y[own], minlength=len(words))
    del pairs, owner, learnt
    known_words = Known(_frequent(whole, documents, len(texts), MAX_WORDS))
    known_grams = Known(_frequent(grams, documents[of], len(texts), MAX_GRAMS))
    net = Network.fresh(known_words, known_grams, seed)
    share = float(y[~back].mean()) if len(y) else 0.0
    net.p["word"][1:, 0] = START * _departure(known_words.find(whole), len(known_words) + 1, seen, toxic, share)[1:]
    net.p["gram"][1:, 0] = START * _departure(known_grams.find(grams), len(known_grams) + 1, seen[of], toxic[of], share)[1:]
    del whole, grams, of
    if not len(codes):
        return net
    feature = net.features(words)
    grid, real, of_text = windows(codes, starts)
    rng = np.random.default_rng(seed)
    by_text = np.split(np.arange(len(of_text)), np.cumsum(np.bincount(of_text, minlength=len(texts)))[:-1])
    full = np.diff(starts) > 0
    pools = [np.flatnonzero((y == v) & full & ~back) for v in (0, 1)]
    judges = np.flatnonzero(full & back)
    if not len(pools[0]) or not len(pools[1]):
        net.p["w"][:] = 0
        net.p["o"][:] = 4.0 if len(pools[1]) else -4.0
        return net
    slow = {k: np.zeros_like(v) for k, v in net.p.items()}
    fast = {k: np.zeros_like(v) for k, v in net.p.items()}
    ptr = np.concatenate(([0], np.cumsum(np.bincount(feature[2], minlength=len(words)))))
    by_word = np.argsort(feature[2], kind="stable")

    def known_of(used: np.ndarray, drop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = ptr[used + 1] - ptr[used]
        pick = by_word[np.arange(sizes.sum()) + np.repeat(ptr[used] - (np.cumsum(sizes) - sizes), sizes)]
        numbers, of = feature[0][used], np.repeat(np.arange(len(used)), sizes)
        if drop:
            there = rng.random(len(used)) >= drop
            numbers, pick, of = np.where(there, numbers, 0), pick[there[of]], of[there[of]]
        return numbers, feature[1][pick], of

    def judged() -> np.ndarray:
        """Logits of the documents kept back."""
        gates, of_judge = net.gates(net.vectors(feature)), np.concatenate([by_text[d] for d in judges])
        best = np.full(len(texts), -np.inf)
        for low in range(0, len(of_judge), 4096):
            part = of_judge[low : low + 4096]
            np.maximum.at(best, of_text[part], net.run(gates, grid[part], real[part]))
        return best[judges]

    def loss() -> float:
        """Their cross entropy, either label counting alike."""
        z = judged()
        each = np.logaddexp(0, z) - y[judges] * z
        return float(np.mean([each[y[judges] == v].mean() for v in (0, 1) if (y[judges] == v).any()]))

    least, kept, waited = np.inf, net.p, 0
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(pool, n) for pool, n in zip(pools, BATCH)])
        own = np.concatenate([by_text[d] for d in chosen])
        text_of = np.repeat(np.arange(len(chosen)), [len(by_text[d]) for d in chosen])
        used, local = np.unique(grid[own], return_inverse=True)
        logits = net.run(net.gates(net.vectors(known_of(used))), local.reshape(grid[own].shape), real[own])
        order = np.lexsort((-logits, text_of))
        top = order[np.concatenate(([True], text_of[order][1:] != text_of[order][:-1]))]
        if step % 4 == 0:  # now and then random windows of the clean
            top = np.concatenate([top, rng.choice(np.flatnonzero(y[chosen][text_of] == 0), 16)])
        used, local = np.unique(grid[own[top]], return_inverse=True)
        known = known_of(used, DROP)
        label = y[chosen][text_of[top]]
        g = net.gradients(
            known, net.vectors(known), local.reshape(len(top), -1), real[own[top]], label, np.full(len(top), 1 / len(top), np.float32)
        )
        rate = 0.015 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in net.p.items():
            slow[k] += 0.1 * (g[k] - slow[k])
            fast[k] += 0.01 * (g[k] * g[k] - fast[k])
            one = rate
            if k in ("word", "gram"):
                v *= 1 - rate * DECAY
                one = rate * WORD_RATE
            v -= one * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-6)
        if step % LOOK == 0 and len(judges):
            now = loss()
            waited += 1
            if now < least:
                least, kept, waited = now, {k: v.copy() for k, v in net.p.items()}, 0
            if waited >= PATIENCE:
                break
    net = Network(net.words, net.grams, kept)
    if len(set(y[judges])) == 2:
        kept["o"] -= _threshold(judged(), y[judges])
    return net


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, steps: int | None = None
) -> Network:
    """A network from at most `toxic` and `clean` labelled rows of least hash of their id; rows without text or label teach nothing.

    Copies of a text teach once for each label. Texts are learnt whole, up to `SAMPLE_WORDS` words of all together.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IN (0, 1)").distinct()
    sizes = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    lot = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_toxic") == 1, F.lit(2.0 * toxic / max(1, sizes.get(1, 0)))).otherwise(F.lit(2.0 * clean / max(1, sizes.get(0, 0))))
    few = marks.where(lot < share)  # some twice as many as wanted
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(few), F.col("doc_id") == F.col("_id"))  # at most some 2 * (toxic + clean) rows
    once = found.groupBy("_toxic", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    parts = [once.where(F.col("_toxic") == value).orderBy("h").limit(most) for value, most in ((1, toxic), (0, clean))]
    # The bounded sample goes to one task, which returns the parameters: the driver holds neither texts nor gradients.
    row = parts[0].unionByName(parts[1]).coalesce(1).mapInArrow(_learn(STEPS if steps is None else steps), "network binary").first()
    return Network.from_bytes(row["network"]) if row else fit([], [])


def _learn(steps: int):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in found for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["h"], r["_toxic"]))
        held, words = [], 0
        for r in rows:
            words += r["text"].count(" ") + 1
            if words > SAMPLE_WORDS and held:
                break
            held.append(r)
        network = fit([r["text"] for r in held], [r["_toxic"] for r in held], steps)
        yield pa.RecordBatch.from_arrays([pa.array([network.to_bytes()], pa.binary())], ["network"])

    return batches


def scored(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row; null texts count as empty."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(network)  # bounded by MAX_WORDS, MAX_GRAMS and SLOTS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], ["doc_id", "score"])

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxic_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; learns labels only of rows whose crc32 of the id as text, modulo `folds`, is not `held`."""
    fold = crc_mod("doc_id", folds)
    network = train(docs, labels.where(fold != held))
    found = scored(docs, network)
    return found.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array(shared.value.scores(batch.column(text_col)) < threshold))

    return docs.mapInArrow(batches, docs.schema)
