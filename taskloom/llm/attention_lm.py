"""Language-model scoring by a small causal self-attention model over subword ids, beside a word-count baseline.

Subwords are the first `VOCABULARY` ranks of a public byte-level vocabulary, which is a smaller vocabulary of the same kind and
covers every byte string. A text is the subwords of its lower-cased words, each with a space before it, and one end. The stream is cut
into windows of `NEW` subwords with the `CONTEXT` subwords before them, so that windows overlap and every subword is scored once,
given at least `CONTEXT` predecessors where there are as many. A window's queries attend to it and to what precedes them; the
output is factored into a group of subwords and a subword within the group.

The model is trained where the data is: every distinct window of the training texts is dealt to one shard of one round. In a round
each of its shards is gone through, in steps from the common parameters, and the parameters are averaged by an aggregate in Spark. The
shards of all rounds together hold each window once. Only the average, whose size is fixed, reaches the driver.

The baseline counts every word of the training documents. Words among the `FREQUENT` most frequent travel to the documents; all
others, none of which can be hot, are joined with their counts by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staging
from .common import arrow_batches, crc_mod, staged
from .subwords import ChunkEncoder, gathered, rank_encoder, vocabulary_path

VOCABULARY = 511
GROUPS = 16
EACH = 32  # subwords of a group; with the end there are 512
END = VOCABULARY
START = VOCABULARY + 1
CONTEXT = 8
NEW = 16
DIM = 16
KEYS = 8
INNER = 24

#: One window in so many is trained on, at every size: all of them. Windows of a shard; rounds; least steps of a shard; windows of a step.
RATE = 1
SHARD_WINDOWS = 65_536
ROUNDS = 3
STEPS = 100
BATCH = 512
#: Words with a share of all tokens of at least 1 / FREQUENT are broadcast (some 20 bytes each); there are at most so many.
FREQUENT = 400_000

_LENGTH = CONTEXT + NEW
#: Stands in a packed window for what lies beyond the end of the text.
_PAST = 1023
_PACKED = _LENGTH + 1 + (_LENGTH + 4) // 4  # bytes: eight bits of each subword, then the upper two of four each
_UPPER = np.array([0, 2, 4, 6], np.uint8)
_SHAPES = {
    "emb": (VOCABULARY + 2, DIM), "pos": (_LENGTH, DIM), "q": (DIM, KEYS), "k": (DIM, KEYS), "v": (DIM, KEYS), "o": (KEYS, DIM),
    "w1": (DIM, INNER), "b1": (INNER,), "w2": (INNER, DIM), "g": (DIM, GROUPS), "gb": (GROUPS,), "m": (GROUPS, DIM, EACH), "mb": (GROUPS, EACH),
}
_SIZES = {name: int(np.prod(shape)) for name, shape in _SHAPES.items()}
PARAMETERS = sum(_SIZES.values())

#: Target j of a window (position CONTEXT + j) sees positions up to its own; logits of what it sees are clipped at 60.
_MOST = np.where(np.arange(_LENGTH)[None, :] > CONTEXT + np.arange(NEW)[:, None], np.float32(-1e9), np.float32(60))


def fresh(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [np.zeros(_SIZES[n]) if n in ("b1", "gb", "mb") else rng.standard_normal(_SIZES[n]) * (0.3 if n == "emb" else 0.2) for n in _SHAPES]
    return np.concatenate(parts).astype(np.float32)


def named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as views."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        out[name] = flat[at : at + _SIZES[name]].reshape(shape)
        at += _SIZES[name]
    return out


def windows(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, which targets are real, text) of all windows; `ids` holds the texts one after the other, each with its end."""
    counts = np.diff(starts)
    per_text = -(-counts // NEW)
    owner = np.repeat(np.arange(len(counts)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = starts[owner] + nth * NEW
    place = np.arange(NEW)
    real = first[:, None] + place < starts[owner + 1][:, None] if len(owner) else np.zeros((0, NEW), bool)
    last = max(0, len(ids) - 1)
    targets = ids[np.minimum(first[:, None] + place, last)] if len(ids) else np.zeros((0, NEW), ids.dtype)
    at = first[:, None] - 1 - CONTEXT + np.arange(_LENGTH)
    inputs = np.where(at < starts[owner][:, None], START, ids[np.clip(at, 0, last)]) if len(ids) else np.zeros((0, _LENGTH), ids.dtype)
    return inputs, targets, real, owner


#: Arrays by use and kind, taken again for every batch of windows: memory that is new each time costs more than the arithmetic in it.
_ROOM: dict[tuple[str, np.dtype], np.ndarray] = {}


def _room(use: str, kind: np.dtype, *shape: int) -> np.ndarray:
    """An array of this shape, with any content; the next call for the same use gives the same memory. A worker is one thread."""
    size = math.prod(shape)
    held = _ROOM.get((use, kind))
    if held is None or held.size < size:
        held = _ROOM[use, kind] = np.empty(size, kind)
    return held[:size].reshape(shape)


def _zeros(kind: np.dtype, size: int) -> np.ndarray:
    """So many zeros, not to be written to: loops over two whole arrays are several times faster than over one and a number."""
    held = _ROOM.get(("zeros", kind))
    if held is None or held.size < size:
        held = _ROOM["zeros", kind] = np.zeros(size, kind)
    return held[:size]


def _add_row(x: np.ndarray, row: np.ndarray, many: int = 64) -> None:
    """x += row, for `many` rows at a time: a loop over one short row costs more than its additions."""
    even = len(x) - len(x) % many
    if even:
        long = x[:even].reshape(-1, many * x.shape[1])
        long += np.tile(row, many)
    x[even:] += row


def _hidden(p: dict[str, np.ndarray], inputs: np.ndarray):
    n, kind = len(inputs), p["emb"].dtype
    x = np.take(p["emb"], inputs, axis=0, out=_room("x", kind, n, _LENGTH, DIM), mode="clip")
    x += p["pos"]
    target = _room("target", kind, n * NEW, DIM)
    target.reshape(n, NEW, DIM)[:] = x[:, CONTEXT:]
    kv = np.matmul(x.reshape(-1, DIM), np.concatenate([p["k"], p["v"]], axis=1), out=_room("kv", kind, n * _LENGTH, 2 * KEYS)).reshape(n, _LENGTH, 2 * KEYS)
    across = _room("across", kind, n, KEYS, _LENGTH)
    across[:] = kv[:, :, :KEYS].transpose(0, 2, 1)
    v = _room("v", kind, n, _LENGTH, KEYS + 1)  # a last column of ones sums the weights up
    v[:, :, :KEYS], v[:, :, KEYS] = kv[:, :, KEYS:], 1
    q = np.matmul(target, p["q"], out=_room("q", kind, n * NEW, KEYS)).reshape(n, NEW, KEYS)
    a = np.matmul(q, across, out=_room("a", kind, n, NEW, _LENGTH))
    np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    sums = np.matmul(a, v, out=_room("sums", kind, n, NEW, KEYS + 1)).reshape(-1, KEYS + 1)
    total = sums[:, KEYS:]
    mixed = np.divide(sums[:, :KEYS], total, out=_room("mixed", kind, n * NEW, KEYS))
    h = np.matmul(mixed, p["o"], out=_room("h", kind, n * NEW, DIM))
    h += target
    inner = np.matmul(h, p["w1"], out=_room("inner", kind, n * NEW, INNER))
    _add_row(inner, p["b1"])
    np.maximum(inner, _zeros(kind, n * NEW * INNER).reshape(inner.shape), out=inner)
    out = np.matmul(inner, p["w2"], out=_room("out", kind, n * NEW, DIM))
    out += h
    return x, q, kv, v, a, total, mixed, h, inner, out


def _by_group(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, rows: np.ndarray):
    """Of these rows, sorted by group: (own hidden values, group, member, logits of groups, of members, which rows each group has)."""
    kind, m = h.dtype, len(rows)
    own = np.take(h, rows, axis=0, out=_room("own", kind, m, DIM), mode="clip")
    y = y[rows]
    group, member = y % GROUPS, y // GROUPS
    logits = np.matmul(own, p["g"], out=_room("groups", kind, m, GROUPS))
    _add_row(logits, p["gb"])
    inside = _room("members", kind, m, EACH)
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    parts = [(g, begin, end) for g, (begin, end) in enumerate(zip([0, *ends], ends)) if end > begin]
    for g, begin, end in parts:
        np.matmul(own[begin:end], p["m"][g], out=inside[begin:end])
    inside += np.take(p["mb"], group, axis=0, out=_room("biases", kind, m, EACH), mode="clip")
    return own, group, member, logits, inside, parts


def _exp(x: np.ndarray) -> np.ndarray:
    """exp in place, and its sum along rows; logits are clipped at 60, far above what training reaches."""
    if x.size and not x.max() <= 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _picked(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where in the flat array the given column of every row stands."""
    return np.arange(0, x.size, x.shape[1]) + columns


def log_probabilities(flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Natural logarithm of the probability of every target of every window."""
    p = named(flat)
    out = np.empty(targets.shape, np.float32)
    for low in range(0, len(inputs), chunk):
        *_, h = _hidden(p, inputs[low : low + chunk])
        y = targets[low : low + chunk].reshape(-1)
        order = np.argsort((y % GROUPS).astype(np.int8), kind="stable")
        _, group, member, logits, inside, _ = _by_group(p, h, y, order)
        found = logits.reshape(-1)[_picked(logits, group)]
        found += inside.reshape(-1)[_picked(inside, member)]
        found -= np.log(_exp(logits) * _exp(inside))
        out[low : low + chunk].reshape(-1)[order] = found
    return out


def _gradient(flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Gradient of the mean cross entropy over the real targets."""
    p, grad = named(flat), np.zeros_like(flat)
    d = named(grad)
    x, q, kv, v, a, total, mixed, h1, inner, h = _hidden(p, inputs)
    n, kind, y, ones = len(inputs), h.dtype, targets.reshape(-1), np.ones(targets.size, h.dtype)  # products with ones are faster than sums
    rows = np.flatnonzero(real.reshape(-1))  # the real targets by group, as in `log_probabilities`
    rows = rows[np.argsort((y[rows] % GROUPS).astype(np.int8), kind="stable")]
    own, group, member, soft, inside, parts = _by_group(p, h, y, rows)
    for logits, goal in ((soft, group), (inside, member)):
        logits *= (1 / _exp(logits))[:, None]
        logits.reshape(-1)[_picked(logits, goal)] -= 1
    d["g"][:], d["gb"][:] = own.T @ soft, ones[: len(own)] @ soft
    d_own = np.matmul(soft, p["g"].T, out=_room("d_own", kind, len(rows), DIM))
    through = _room("through", kind, len(rows), DIM)
    for g, begin, end in parts:
        some = inside[begin:end]
        np.matmul(own[begin:end].T, some, out=d["m"][g])
        np.matmul(ones[begin:end], some, out=d["mb"][g])
        np.matmul(some, p["m"][g].T, out=through[begin:end])
    d_own += through
    place = np.zeros(n * NEW, np.int64)
    place[rows] = np.arange(len(rows))
    d_h = np.take(d_own, place, axis=0, out=_room("d_h", kind, n * NEW, DIM), mode="clip") if len(rows) else np.zeros((n * NEW, DIM), kind)
    if len(rows) < n * NEW:
        d_h[~real.reshape(-1)] = 0
    d["w2"][:] = inner.T @ d_h
    d_inner = np.matmul(d_h, p["w2"].T, out=_room("d_inner", kind, n * NEW, INNER))
    d_inner *= inner > 0
    d["w1"][:], d["b1"][:] = h1.T @ d_inner, ones @ d_inner
    d_h += np.matmul(d_inner, p["w1"].T, out=_room("d_through", kind, n * NEW, DIM))
    d["o"][:] = mixed.T @ d_h
    # With the weights a not divided by their sum yet, a target's d_s is a * (d_mixed @ v - mixed @ d_mixed) / total: the subtrahend meets
    # the column of ones in v.
    d_sums = _room("d_sums", kind, n * NEW, KEYS + 1)
    d_mixed = np.matmul(d_h, p["o"].T, out=_room("d_mixed", kind, n * NEW, KEYS))
    d_mixed /= total
    d_sums[:, :KEYS] = d_mixed
    d_sums[:, KEYS] = -np.einsum("ij,ij->i", d_mixed, mixed)
    d_sums = d_sums.reshape(n, NEW, KEYS + 1)
    d_s = np.matmul(d_sums, v.transpose(0, 2, 1), out=_room("d_s", kind, n, NEW, _LENGTH))
    d_s *= a
    d_kvq = _room("d_kvq", kind, n, _LENGTH, 3 * KEYS)
    d_kvq[:, :CONTEXT, 2 * KEYS :] = 0
    np.matmul(d_s, kv[:, :, :KEYS], out=d_kvq[:, CONTEXT:, 2 * KEYS :])
    np.matmul(d_s.transpose(0, 2, 1), q, out=d_kvq[:, :, :KEYS])
    np.matmul(a.transpose(0, 2, 1), d_mixed.reshape(n, NEW, KEYS), out=d_kvq[:, :, KEYS : 2 * KEYS])
    d_kvq = d_kvq.reshape(-1, 3 * KEYS)
    d["k"][:], d["v"][:], d["q"][:] = np.split(x.reshape(-1, DIM).T @ d_kvq, 3, axis=1)
    d_x = np.matmul(d_kvq, np.concatenate([p["k"], p["v"], p["q"]], axis=1).T, out=_room("d_x", kind, n * _LENGTH, DIM)).reshape(n, _LENGTH, DIM)
    d_x[:, CONTEXT:] += d_h.reshape(n, NEW, DIM)
    d["pos"][:] = (np.ones(n, kind) @ d_x.reshape(n, -1)).reshape(_LENGTH, DIM)
    # Rows of one subword side by side are summed up at once.
    ids = inputs.reshape(-1).astype(np.int16)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=VOCABULARY + 2)
    there = np.flatnonzero(counts)
    sorted_dx = np.take(d_x.reshape(-1, DIM), order, axis=0, out=_room("sorted", kind, n * _LENGTH, DIM), mode="clip")
    d["emb"][there] = np.add.reduceat(sorted_dx, (np.cumsum(counts) - counts)[there], axis=0)
    grad /= max(1, len(rows))
    return grad


def descend(flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, steps: int, rate: float, seed: int) -> np.ndarray:
    """Parameters after so many steps over windows drawn in random order."""
    flat, rng = flat.copy(), np.random.default_rng(seed)
    slow, fast = np.zeros_like(flat), np.zeros_like(flat)
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(inputs))])
        at, order = order[:BATCH], order[BATCH:]
        g = _gradient(flat, inputs[at], targets[at], real[at])
        slow += 0.1 * (g - slow)
        fast += 0.01 * (g * g - fast)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        flat -= now * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-7)
    return flat


# ---------------------------------------------------------------------------------------------------------------- texts to subwords

_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = rank_encoder(path, VOCABULARY)
    return _ENCODERS[path]


class Words:
    """The lower-cased words of a batch of texts: distinct ones, codes, and where each text's words start."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = pc.dictionary_encode(lists.flatten())
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        kept = np.concatenate(([0], np.cumsum(filled)))
        self.distinct = flat.dictionary
        self.codes = codes[filled]
        self.starts = kept[np.concatenate(([0], np.cumsum(counts)))]
        self.pool = self.sizes = None

    def subwords(self, encoder: ChunkEncoder, texts: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, or of those in a slice, each with its end; where each starts). Distinct words are encoded once."""
        if self.pool is None:
            pool, sizes = encoder.pooled(pc.binary_join_element_wise(pa.scalar(" "), self.distinct, ""))
            self.pool, self.sizes = np.append(pool, np.uint16(END)).astype(np.int32), np.append(sizes, 1)
        low, high, _ = texts.indices(len(self.starts) - 1)
        starts = self.starts[low : high + 1]
        # The end is one more chunk after the last word of every text.
        codes = np.insert(self.codes[starts[0] : starts[-1]], starts[1:] - starts[0], len(self.sizes) - 1)
        starts = starts - starts[0] + np.arange(len(starts))
        ids, ends = gathered(self.pool, self.sizes, codes)
        return ids, ends[starts]


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def training_windows(docs: DataFrame, path: str, rate: int, text_col: str = "text") -> DataFrame:
    """Packed windows, all of them or one in `rate`, chosen by a hash of the text's length and the window's place and first subwords."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in found:
            words = Words(batch.column(0))
            for low in range(0, batch.num_rows, 256):
                ids, starts = words.subwords(encoder, slice(low, min(low + 256, batch.num_rows)))
                inputs, targets, real, owner = windows(ids, starts)
                rows = packed(inputs, targets, real)
                if rate > 1:
                    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    rows = rows[_hash(np.diff(starts)[owner], nth, targets[:, 0], targets[:, 1]) % np.uint64(rate) == 0]
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_PACKED), len(rows), [None, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([binary.cast(pa.binary())], ["ids"])

    return docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(batches, "ids binary")


def packed(inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Ten bits a subword, a row for each window: its inputs, all but the first ones of which are targets too, and its last target."""
    ids = np.concatenate([inputs, targets[:, -1:]], axis=1).astype(np.uint16)
    ids[:, CONTEXT + 1 :][~real] = _PAST
    upper = np.zeros((len(ids), 4 * (_PACKED - _LENGTH - 1)), np.uint8)
    upper[:, : _LENGTH + 1] = ids >> 8
    return np.concatenate([ids.astype(np.uint8), np.bitwise_or.reduce(upper.reshape(len(ids), -1, 4) << _UPPER, axis=2)], axis=1)


def unpacked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, which targets are real); 0 stands beyond the end of a text, which no real target sees."""
    upper = (rows[:, _LENGTH + 1 :, None] >> _UPPER & 3).reshape(len(rows), -1)[:, : _LENGTH + 1]
    ids = rows[:, : _LENGTH + 1] | upper.astype(np.int32) << 8
    real = ids[:, CONTEXT + 1 :] != _PAST
    ids[ids == _PAST] = 0
    return ids[:, :_LENGTH], ids[:, CONTEXT + 1 :], real


def _local_round(shared, r: int, steps: int):
    """One pass over a shard or, where that is less, so many steps."""

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(sorted(pdf["ids"])), np.uint8).reshape(-1, _PACKED)
        found = descend(shared.value, *unpacked(rows), max(steps, -(-len(rows) // BATCH)), 0.02 / (1 + r), r)
        return pd.DataFrame({"number": np.arange(PARAMETERS), "value": found.astype(np.float64), "weight": float(len(rows))})

    return local


def train(docs: DataFrame, vocabulary: str, rate: int = RATE, rounds: int = ROUNDS, steps: int = STEPS, shard: int = SHARD_WINDOWS, text_col: str = "text") -> np.ndarray:
    """Parameters learnt from every window of the rows' texts, or from one in `rate`, at every size; fresh ones if there is none.

    Equal windows are one, however many copies of a text there are: they would all fall into one shard and outweigh the rest.
    """
    with staging():
        return _trained(docs, vocabulary, rate, rounds, steps, shard, text_col)


def _trained(docs: DataFrame, vocabulary: str, rate: int, rounds: int, steps: int, shard: int, text_col: str) -> np.ndarray:
    spark = docs.sparkSession
    distinct = staged(training_windows(docs, vocabulary, rate, text_col).distinct(), "lm-windows")
    count = distinct.count()
    flat = fresh()
    if not count:
        return flat
    shards = max(1, count // (shard * rounds))  # of a round
    dealt = staged(distinct.select("ids", F.pmod(F.xxhash64("ids"), F.lit(rounds * shards)).cast("int").alias("shard")), "lm-shards")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(flat)
        of_round = dealt.where(F.col("shard").between(r * shards, (r + 1) * shards - 1))
        updates = of_round.groupBy("shard").applyInPandas(_local_round(shared, r, steps), "number int, value double, weight double")
        mean = updates.groupBy("number").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
        for row in staged(mean, "lm-mean").collect():  # one number for each parameter
            flat[row["number"]] = row["value"]
    return flat


# --------------------------------------------------------------------------------------------------------------------------- scores


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of all words of the rows; each text ends with one end, the empty word. Batches are counted before the exchange."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            words = Words(batch.column(0))
            counts = np.bincount(words.codes, minlength=len(words.distinct))
            used = np.flatnonzero(counts)
            names = pa.concat_arrays([words.distinct.take(pa.array(used)), pa.array([""])])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(counts[used], batch.num_rows))], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, held_out: F.Column, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", parameters: np.ndarray | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows that aren't held out.

    Tokens of the baseline are words and one end; base_score is their log10 probability by add-half counts. score is the model's
    log10 probability of the subwords of all words and the end. Null texts count as empty: the end alone. Rows that repeat
    are scored each. With nothing to learn from, the baseline gives every token the same probability.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    arrow_batches(spark, 2048)
    learn = docs.where(~held_out)
    counts = staged(word_counts(learn, text_col), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    base = float(n + 0.5 * (v + 1))
    # The others have less than a share of 1 / FREQUENT of all tokens each, so that no key of the join below is hot.
    often = F.col("n") * FREQUENT >= n
    top = {r["word"]: r["n"] for r in counts.where("word <> ''").where(often).collect()}  # FREQUENT at most, by their shares
    top_end = counts.where("word = ''").first()
    end = int(top_end["n"]) if top_end else 0
    looked_up = pa.array(top, pa.string()), np.array([*top.values(), -1], np.int64)  # -1 for words that aren't among them
    shared = spark.sparkContext.broadcast((*looked_up, train(learn, path, text_col=text_col) if parameters is None else parameters))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, rare_n array<int>"

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, numbers, flat = shared.value
        encoder = _encoder(path)
        for batch in found:
            words = Words(batch.column("text"))
            lot = words.distinct
            count = numbers[pc.fill_null(pc.index_in(lot, frequent), -1).to_numpy(zero_copy_only=False)]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.starts))
            known = count[words.codes]
            hit = known >= 0
            log = np.log10(np.maximum(known, 0) + 0.5)
            partial = np.bincount(owner, weights=np.where(hit, log, 0), minlength=batch.num_rows) + np.log10(end + 0.5)
            n_known = np.bincount(owner, weights=hit & (known > 0), minlength=batch.num_rows).astype(np.int64) + int(end > 0)
            # Other words, once for each text that holds them.
            pairs, times = np.unique(owner[~hit] * max(1, len(lot)) + words.codes[~hit], return_counts=True)
            of, word = pairs // max(1, len(lot)), pairs % max(1, len(lot))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=batch.num_rows)))).astype(np.int32))
            rare = pa.ListArray.from_arrays(offsets, lot.take(pa.array(word)))
            rare_n = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
            model = np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows, 256):
                texts = slice(low, min(low + 256, batch.num_rows))
                ids, starts = words.subwords(encoder, texts)
                inputs, targets, real, text = windows(ids, starts)
                logs = log_probabilities(flat, inputs, targets)
                model[texts] = np.bincount(text, weights=np.where(real, logs, 0).sum(axis=1, dtype=np.float64), minlength=len(starts) - 1) / np.log(10)
            sizes = np.diff(words.starts) + 1
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(n_known), pa.array(partial), pa.array(model), rare, rare_n]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = staged(rows.mapInArrow(batches, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    other = made.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times"))
    looked = other.join(counts.where(~often & (F.col("word") != "")), "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5) * F.col("times")
    sums = looked.groupBy("row").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    joined = made.drop("rare", "rare_n").join(sums, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(base))).alias("base_score"), "score",
    )


def corpus_scores(docs: DataFrame, folds: int = 5, held: int = 1, vocabulary: str | None = None) -> DataFrame:
    """`scores` with the rows held out whose crc32 of the id as text, modulo `folds`, is `held`."""
    return scores(docs, crc_mod("doc_id", folds) == held, vocabulary)
