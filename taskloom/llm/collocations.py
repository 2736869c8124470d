"""Phrase collocations from a prefix-free parse.

Texts are parsed into chunks that start at trigger words (one word in `TRIGGER`, by its hash) and run on for up to three words
into the next chunk, as far as a phrase of four words can. The distinct chunks are the dictionary, with their frequencies in the parse;
copies of a passage become one chunk of a higher frequency. A phrase is counted where it starts, in the chunk's own words, weighted
by the chunk's frequency: phrases that run into the overlap are counted once.

A phrase that occurs `least` times consists of phrases that do. The dictionary is read three times: words, then pairs of frequent words (as
64-bit hashes; a collision can only let a pair through), then, as strings and exactly, phrases all of whose pairs are frequent. What is
frequent goes to the tasks as a bitmap of hashes, of at most `MAX_BITS` bits; a fuller bitmap lets more phrases through to be
counted, and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import cut_strings, flat_bytes
from .common import arrow_batches, staged
from .syncmers import _mixed

MOST_WORDS = 4
LEAST = 30
SHARE = 80
TOP = 2000
#: One word in so many starts a chunk.
TRIGGER = 16
#: Bits of a bitmap for each frequent phrase, and at most.
BITS_EACH = 32
MAX_BITS = 1 << 26
#: Bytes parsed at a time; a slice ends at the end of a piece.
SLICE = 1 << 20
CHUNK_ROWS = 16384

_SPACE, _BREAK = 32, 10
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = _SPACE
_FOLD[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _BREAK

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            many = np.full(max(n, 1 << 16), base, np.uint64)
            many[0] = 1
            _powers[i] = np.cumprod(many, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of texts that lie one after the other: where they start and end, their text, their piece, their hash."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(flat)
        opens = np.bincount(starts[starts < n], minlength=n)[:n] if n else np.zeros(0, np.int64)
        inside = (flat != _SPACE) & (flat != _BREAK)
        head = inside.copy()
        head[1:] &= ~inside[:-1] | (opens[1:] > 0)
        tail = inside.copy()
        tail[:-1] &= ~inside[1:] | (opens[1:] > 0)
        self.flat, self.start, self.end = flat, np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.text = np.searchsorted(starts, self.start, "right") - 1
        self.piece = np.cumsum((flat == _BREAK) | (opens > 0))[self.start] if n else self.start
        forth, back = _power(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * forth[:n], dtype=np.uint64)))
        self.hash = _mixed((sums[self.end] - sums[self.start]) * back[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def run(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in one piece."""
        ok = np.zeros(len(self), bool)
        if len(self) >= n:
            ok[: len(self) - n + 1] = self.piece[n - 1 :] == self.piece[: len(self) - n + 1]
        return ok


def _slices(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The texts in slices that end where a text or a piece ends: bytes, starts and ends in them, the number of the first text."""
    low = 0
    while low < len(flat):
        high = low + SLICE
        if high < len(flat):
            stop = np.flatnonzero(flat[high : high + SLICE] == _BREAK)
            following = ends[np.searchsorted(ends, high)]
            high = min(int(following), high + int(stop[0]) if len(stop) else len(flat))
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        yield flat[low:high], np.maximum(starts[first:last], low) - low, np.minimum(ends[first:last], high) - low, int(first)
        low = high


def parsed(words: Words, trigger: int, overlap: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, their numbers of own words, their texts). Words of a chunk are parted by one space, or one line feed between pieces."""
    n = len(words)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    opens = (words.hash % np.uint64(trigger) == 0) | (np.diff(words.text, prepend=-1) != 0)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n)  # behind the last own word
    reach = last.copy()
    for ahead in range(overlap):
        at = np.minimum(last + ahead, n - 1)
        reach += (reach == last + ahead) & (last + ahead < n) & (words.piece[at] == words.piece[last - 1])
    # Words one after the other, with one separator behind each.
    sizes = words.end - words.start + 1
    begins = np.concatenate(([0], np.cumsum(sizes)))
    tight = np.append(words.flat, np.uint8(0))[np.arange(begins[-1]) + np.repeat(words.start - begins[:-1], sizes)]
    behind = np.full(n, _BREAK, np.uint8)
    behind[:-1][words.piece[1:] == words.piece[:-1]] = _SPACE
    tight[begins[1:] - 1] = behind
    return cut_strings(tight, begins[first], begins[reach] - 1), (last - first).astype(np.int32), words.text[first]


def _parse_batches(trigger: int, overlap: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            flat, starts, ends = flat_bytes(batch.column("text"))
            for some, begins, stops, first in _slices(_FOLD[flat], starts, ends):
                chunks, own, texts = parsed(Words(some, begins, stops), trigger, overlap)
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(texts + first)), chunks, pa.array(own)], ["lang", "chunk", "own"])

    return batches


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", trigger: int = TRIGGER, overlap: int = MOST_WORDS - 1) -> DataFrame:
    """lang, chunk, own (number of words that are not overlap), freq of every distinct chunk of the parse."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chunks = narrow.mapInArrow(_parse_batches(trigger, overlap), "lang string, chunk string, own int")
    return chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("freq"))


class _Grams:
    """Phrases of a batch of chunks by the place of their first word, with 64-bit hashes that tell languages apart."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = Words(*flat_bytes(batch.column("chunk")))
        langs = batch.column("lang").dictionary_encode()
        salts = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
        text = self.words.text
        first = np.searchsorted(text, np.arange(batch.num_rows), "left")
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[text]
        self.names = langs.dictionary
        self.own = np.arange(len(text)) - first[text] < batch.column("own").to_numpy(zero_copy_only=False)[text]
        self.freq = batch.column("freq").to_numpy(zero_copy_only=False)[text]
        self.hash = _mixed(self.words.hash ^ salts[self.lang]) if len(text) else self.words.hash

    def longer(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of phrases of n words from those of n - 1."""
        out = np.zeros(len(hashes), np.uint64)
        if len(hashes) >= n:
            out[: len(hashes) - n + 1] = _mixed(hashes[: len(hashes) - n + 1] * np.uint64(_STEP) + self.hash[n - 1 :])
        return out

    def summed(self, at: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        """lang, phrase, n of the phrases of n words at some words, equal ones added up."""
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inverse, self.freq[at])
        at, n = at[first], n[first]
        phrases = cut_strings(self.words.flat, self.words.start[at], self.words.end[at + n - 1])
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[at])), phrases, pa.array(n, pa.int32()), pa.array(total)], ["lang", "phrase", "words", "n"])


def _word_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        grams = _Grams(batch)
        at = np.flatnonzero(grams.own)
        yield grams.summed(at, np.ones(len(at), np.int64), grams.hash[at])


def _word_hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        flat, starts, ends = flat_bytes(batch.column("phrase"))
        langs = batch.column("lang").dictionary_encode()
        salts = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
        words = Words(flat, starts, ends).hash
        hashes = _mixed(words ^ salts[langs.indices.to_numpy(zero_copy_only=False)]) if len(words) else words
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of hashes `h` as 64-bit words: at most `MAX_BITS` bits reach the driver, put together by Spark."""
    bits = min(MAX_BITS, max(64, 1 << (BITS_EACH * hashes.count()).bit_length()))
    slot = F.col("h").bitwiseAND(bits - 1)
    one = F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))")
    words = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _pair_hashes(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = frequent.value
        for batch in rows:
            grams = _Grams(batch)
            known = _holds(bitmap, grams.hash)
            known[:-1] &= known[1:]
            at = np.flatnonzero(grams.own & grams.words.run(2) & known)
            hashes, inverse = np.unique(grams.longer(grams.hash, 2)[at], return_inverse=True)
            total = np.zeros(len(hashes), np.int64)
            np.add.at(total, inverse, grams.freq[at])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(total)], ["h", "n"])

    return batches


def _phrase_counts(frequent, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = frequent.value
        for batch in rows:
            grams = _Grams(batch)
            hashes = grams.longer(grams.hash, 2)
            pair = grams.words.run(2) & _holds(bitmap, hashes)
            alive = pair & grams.own
            at, sizes, keys = [], [], []
            for n in range(2, most + 1):
                if n > 2:  # the pair of the last two words has to be frequent as well
                    hashes = grams.longer(hashes, n)
                    alive = alive & np.append(pair[n - 2 :], np.zeros(min(n - 2, len(pair)), bool)) & grams.words.run(n)
                found = np.flatnonzero(alive)
                at.append(found)
                sizes.append(np.full(len(found), n))
                keys.append(_mixed(hashes[found] + np.uint64(n)))
            yield grams.summed(np.concatenate(at), np.concatenate(sizes), np.concatenate(keys))

    return batches


_COUNTS = "lang string, phrase string, words int, n long"


def phrase_counts(chunks: DataFrame, least: int = LEAST, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n of every phrase of up to `most` words with n >= least; lang, n of all words) of a staged dictionary."""
    spark = chunks.sparkSession
    arrow_batches(spark, CHUNK_ROWS)
    by_phrase = ["lang", "phrase", "words"]
    words = staged(chunks.mapInArrow(_word_counts, _COUNTS).groupBy(*by_phrase).agg(F.sum("n").alias("n")), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= least)
    known = spark.sparkContext.broadcast(_bitmap(words.mapInArrow(_word_hashes, "h long")))
    pairs = chunks.mapInArrow(_pair_hashes(known), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    pairs = staged(pairs.where(F.col("n") >= least).select("h"), "phrase-pairs")
    known = spark.sparkContext.broadcast(_bitmap(pairs))
    longer = chunks.mapInArrow(_phrase_counts(known, most), _COUNTS).groupBy(*by_phrase).agg(F.sum("n").alias("n"))
    return staged(longer.where(F.col("n") >= least).unionByName(words), "phrase-counts"), totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, most: int = MOST_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to `most` words of every language.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. a counts a phrase,
    l and r the parts of its worst cut, n all words; score is floor(2000000 * a / (l + r)), exactly. Phrases with a below `least` and
    those inside a longer one with at least `share` per cent of their count are left out. Ties go by a, then by the phrase's bytes.
    Null texts are empty, a null language is `und`; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    chunks = staged(dictionary(docs, text_col, lang_col, overlap=most - 1), "phrase-dictionary")
    counts, totals = phrase_counts(chunks, least, most)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest")
    )
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = parts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longest = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    fits = F.col("longer").isNull() | (F.col("longer").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * share)
    kept = worst.join(longest, ["lang", "phrase"], "left").where(fits)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
