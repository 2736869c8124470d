"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds all substrings of a sample of its labelled text. A text is parsed against each language
from left to right into longest phrases that occur in that language's sample; a character that never occurs is a phrase of its
own. A phrase costs log2(sample length) bits, and a character that the language's sample doesn't hold as much as a phrase of the
longest sample, so that a small sample gains nothing by what it lacks. Bits / characters estimates the cross entropy, and the language
of the least wins.

The automata become one table of next states with marks where a phrase begins and where a character is unseen, so that many stretches of
text are parsed at once, one character a step. The `CLASSES` most frequent characters have a column each; steps by the other
characters of the samples are sorted keys. Whole texts are parsed, in stretches of `STRETCH` characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, crc_mod, staged

#: Characters of labelled text a language's automaton holds, and of all languages together: the bound of the sample.
SAMPLE_CHARS = 24_000
TOTAL_CHARS = 96_000
#: Characters taken from one document for the sample.
SLICE_CHARS = 240
STRETCH = 512
#: Characters parsed at a time (some 25 bytes of memory each); a longer text is parsed on its own.
PARSED_CHARS = 1 << 20
#: Characters of a passage when it is asked whether any language fits: each passage may be in another one.
PASSAGE = 32
#: Shorter plain texts are not judged. A text fits up to SLACK times the median, or the given quantile, of held-out text of its language.
LEAST_CHARS = 160
SLACK = 1.4
QUANTILE = 0.99
RANKS = 10_000
#: Longer words, of scripts without spaces, are counted in pieces of so many characters.
LONG_WORD = 24
PIECE = 4
#: Characters with a column of their own in the table.
CLASSES = 200
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
#: Marks above a state: a phrase begins; the character is unseen. Marks of a stretch are summed up, at most STRETCH < 1024 of each.
_BEGINS = 1 << 20
_UNSEEN = 1 << 30
_POINTS = 0x110000


def plain(text: str) -> str:
    """Lower-cased letters, everything between them one space."""
    return _OTHER.sub(" ", text.lower())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return step


@dataclass
class CrossParser:
    """Tables of all languages: `table[state, class]` is the next state, plus `_BEGINS` where a phrase begins and `_UNSEEN`.

    Classes beyond the table's columns are rare: `rare_steps` holds what follows the keys state * `_POINTS` + class; with no step from
    a state, the one from the language's root holds.
    """

    languages: list[str]
    table: np.ndarray
    roots: np.ndarray
    weights: np.ndarray  # log2 of the sample length
    classes: np.ndarray  # class of every code point
    rare_keys: np.ndarray
    rare_steps: np.ndarray

    def codes(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _rare_moves(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Steps of all languages by rare classes."""
        last = len(self.rare_keys) - 1
        keys = state * np.int64(_POINTS) + codes
        at = np.minimum(np.searchsorted(self.rare_keys, keys), last)
        first = self.roots[:, None] * np.int64(_POINTS) + codes
        anew = np.minimum(np.searchsorted(self.rare_keys, first), last)
        begun = np.where(self.rare_keys[anew] == first, self.rare_steps[anew], self.roots[:, None] | (_BEGINS | _UNSEEN))
        return np.where(self.rare_keys[at] == keys, self.rare_steps[at], begun)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, characters parsed by text)."""
        total, _, sizes, _ = self._parse(texts)
        return total, sizes

    def parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases and unseen characters by text and language, characters parsed by text)."""
        return self._parse(texts)[:3]

    def _cost(self, marks: np.ndarray, weight: float) -> np.ndarray:
        return ((marks & 1023) - (marks >> 10)) * weight + (marks >> 10) * self.weights.max()

    def fit(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least language, bits a character when every passage is in the language that suits it, characters) of plain texts."""
        phrases, unseen, sizes, passages = self._parse(texts, True)
        bits = (phrases - unseen) * self.weights + unseen * self.weights.max()
        return bits.argmin(axis=1), passages / np.maximum(sizes, 1), sizes

    def _parse(self, texts: list[str], by_passage: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, so many at a time as `PARSED_CHARS` allows: a worker's memory doesn't grow with the rows of a batch."""
        cuts, chars = [0], 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars > PARSED_CHARS and i > cuts[-1]:
                cuts.append(i)
                chars = len(t)
        parts = [self._parse_some(texts[a:b], by_passage) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
        return tuple(map(np.concatenate, zip(*parts)))

    def _parse_some(self, texts: list[str], by_passage: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        coded = [self.codes(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        lanes = -(-sizes // STRETCH)
        grid = np.zeros((int(lanes.sum()), STRETCH), np.int32)  # class 0 fills up and counts nothing
        row = 0
        for c, n in zip(coded, lanes.tolist()):
            grid[row : row + n].reshape(-1)[: len(c)] = c
            row += n
        del coded
        counts = np.zeros((len(self.languages), len(grid)), np.int32)
        columns = np.ascontiguousarray(grid.T)
        width = self.table.shape[1]
        flat = self.table.reshape(-1)
        order = np.argsort(-(grid != 0).sum(axis=1), kind="stable")  # long stretches first: finished ones drop off the end
        columns = columns[:, order]
        filled = (columns != 0).sum(axis=1)
        rare = columns >= width
        some = rare.any(axis=1)
        dense = np.where(rare, 1, columns)
        state = np.repeat(self.roots[:, None], len(grid), axis=1)
        least, before = np.zeros(len(grid)), counts.copy()
        for t in range(STRETCH):
            n = int(filled[t])
            if by_passage and t and (t % PASSAGE == 0 or not n):
                least += np.min([self._cost(c, w) for c, w in zip(counts - before, self.weights)], axis=0)
                before = counts.copy()
            if not n:
                break
            move = flat[state[:, :n] * width + dense[t, :n]]
            if some[t]:
                at = np.flatnonzero(rare[t, :n])
                move[:, at] = self._rare_moves(state[:, at], columns[t, at])
            counts[:, order[:n]] += move >> 20
            state[:, :n] = move & (_BEGINS - 1)
        if by_passage:
            least += np.min([self._cost(c, w) for c, w in zip(counts - before, self.weights)], axis=0)
        owner = np.repeat(np.arange(len(texts)), lanes)
        total, unseen = np.zeros((2, len(texts), len(self.languages)), np.int64)
        for k in range(len(self.languages)):
            for out, marks in ((total, counts[k] & 1023), (unseen, counts[k] >> 10)):
                out[:, k] = np.bincount(owner, weights=marks, minlength=len(texts)).astype(np.int64) if len(owner) else 0
        return total, unseen, sizes, np.bincount(owner, weights=least, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a character) of every text."""
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        if not self.languages or not any(known):
            return [(UNKNOWN, 0.0, None)] * len(texts)
        phrases, unseen, sizes = self.parsed([plain(t) for t, k in zip(texts, known) if k])
        bits = ((phrases - unseen) * self.weights + unseen * self.weights.max()) / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(axis=1)  # of equal ones the first by name
        least = bits.min(axis=1)
        # Relative likelihood of the best, were the characters of a short passage coded at these rates.
        score = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(sizes, 64)[:, None]).sum(axis=1)
        found = iter(zip(best.tolist(), score.tolist(), least.tolist()))
        out = []
        for k in known:
            if k:
                b, s, e = next(found)
                out.append((self.languages[b], s, e))
            else:
                out.append((UNKNOWN, 0.0, None))
        return out


def build(samples: dict[str, str]) -> CrossParser:
    """Automata of plain texts by language."""
    languages = sorted(k for k, v in samples.items() if v.strip())
    letters = [c for c, _ in Counter("".join(samples[k] for k in languages)).most_common()]
    classes = np.full(_POINTS, 1, np.int32)  # 0 fills up, 1 is unseen
    for i, c in enumerate(letters):
        classes[ord(c)] = i + 2
    width, tables, roots, base = min(len(letters), CLASSES) + 2, [], [], 0
    rare: dict[int, int] = {}
    for k in languages:
        codes = classes[np.frombuffer(samples[k].encode("utf-32-le"), np.uint32)].tolist()
        steps = suffix_automaton(codes)
        start = np.full(width, base | _BEGINS | _UNSEEN, np.int64)
        table = np.repeat(start[None, :], len(steps), axis=0)
        for c, s in steps[0].items():
            if c < width:
                table[:, c] = (base + s) | _BEGINS
            else:
                rare[base * _POINTS + c] = (base + s) | _BEGINS
        for state, moves in enumerate(steps[1:], 1):
            for c, s in moves.items():
                if c < width:
                    table[state, c] = base + s
                else:
                    rare[(base + state) * _POINTS + c] = base + s
        table[:, 0] = base
        tables.append(table.astype(np.int32))
        roots.append(base)
        base += len(steps)
    assert base < _BEGINS  # twice the characters of all samples
    keys = np.array(sorted(rare), np.int64)
    following = np.array([rare[k] for k in keys.tolist()], np.int32)
    weights = np.array([np.log2(max(2, len(samples[k]))) for k in languages])
    table = np.concatenate(tables) if tables else np.zeros((0, width), np.int32)
    return CrossParser(languages, table, np.array(roots, np.int32), weights, classes, keys, following)


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS, text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """Automata from a sample of bounded size: slices from the middle of documents of least hash, each text once.

    Rows without text, letters or language teach nothing. With so many languages that `total_chars` would be passed, each gets less.
    Rare languages use what there is; beyond total_chars / SLICE_CHARS languages only the most frequent are learned.
    """
    taken, chars = _slices(docs, sample_chars, total_chars, text_col, lang_col, SLICE_CHARS)
    return build({lang: " ".join(plain(p) for p in parts)[:chars] for lang, parts in taken.items()})


def _slices(docs: DataFrame, sample_chars: int, total_chars: int, text_col: str, lang_col: str, slice_chars: int) -> tuple[dict[str, list[str]], int]:
    """(slices by language, characters for a language): from the middle of documents of least hash, each text once."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.substring(F.col("text"), F.greatest(F.lit(1), F.floor((F.length("text") - slice_chars) / 2).cast("int") + 1), F.lit(slice_chars)).alias("slice"))
    # Copies count once: the share below is one of distinct texts.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in counts.orderBy(F.desc("n"), "lang").limit(total_chars // slice_chars).collect()}
    if not sizes:
        return {}, 0
    chars = min(sample_chars, total_chars // len(sizes))
    wanted = max(1, 2 * chars // slice_chars)
    # A row is looked at if its hash lies among the least share that should hold four times the texts wanted.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4.0 * wanted / max(1, n)))])
    lot = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.where(F.element_at(share, F.col("lang")) > lot).groupBy("lang", "h").agg(F.min("slice").alias("slice"))
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("nth") <= wanted)
    taken: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "nth").collect():  # at most 2 * total_chars characters
        taken.setdefault(r["lang"], []).append(r["slice"])
    return taken, chars


def _distinct_texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, text of labelled rows, each text once a language: copies are merged before the exchange."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("lang", "text")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n over whole distinct texts; words of more than `LONG_WORD` characters (scripts without spaces) count as pieces of `PIECE`."""
    arrow_batches(docs.sparkSession)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = plain(text).split()
                if len(max(words, key=len, default="")) > LONG_WORD:
                    words = [p for w in words for p in ([w] if len(w) <= LONG_WORD else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
                counts.setdefault(lang, Counter()).update(words)
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])

    return _distinct_texts(docs, text_col, lang_col).mapInArrow(batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train_on_all(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS, text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """Automata of the most frequent words of each language, counted over the whole of all labelled texts, copies once.

    `sample_chars` and `total_chars` bound the automata, not what is read. Of more than total_chars / SLICE_CHARS languages only
    those of the most words are learned.
    """
    counts = staged(word_counts(docs, text_col, lang_col), "language-words")
    most = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(total_chars // SLICE_CHARS).collect()
    if not most:
        return build({})
    chars = min(sample_chars, total_chars // len(most))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counts.where(F.col("lang").isin([r["lang"] for r in most])).withColumn("nth", nth).where(F.col("nth") <= chars // 2)
    words: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "nth").collect():  # at most total_chars / 2 words
        words.setdefault(r["lang"], []).append(r["word"])
    return build({lang: " ".join(own)[:chars] for lang, own in words.items()})


def predictions(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits of every row: `und`, 0 and null where the text is null or has no letter."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(parser)  # its size is bounded by total_chars and the code points
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = shared.value.predict(batch.column("text").to_pylist())
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "bits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, bits double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits; learns from rows whose crc32 of the id as text, modulo `folds`, is not `held`."""
    fold = crc_mod(id_col, folds)
    parser = train(docs.where(fold != held), text_col=text_col, lang_col=lang_col)
    found = predictions(docs, parser, id_col, text_col)
    return found.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "bits")


def limits(docs: DataFrame, parser: CrossParser, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """The most bits a character, by language of the parser, of a text in it; from all labelled rows, which the parser has not seen.

    Each text counts once, whole. Quantiles are those of a sketch over all of them, off by a rank in `RANKS`. A language with less than
    ten such texts of `LEAST_CHARS` takes the greatest limit of the others; with none, every text fits.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(parser)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            long = np.array([len(t) >= LEAST_CHARS for t in texts], bool)
            if long.any():
                _, bits, _ = shared.value.fit([t for t, k in zip(texts, long) if k])
                yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(long)), pa.array(bits, pa.float64())], ["lang", "bits"])

    found = np.full(len(parser.languages), np.nan)
    if parser.languages:
        texts = _distinct_texts(docs, text_col, lang_col).where(F.col("lang").isin(parser.languages))
        bits = texts.mapInArrow(batches, "lang string, bits double").groupBy("lang")
        cuts = F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(QUANTILE)), F.lit(RANKS))
        for r in bits.agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")).collect():  # one row a language
            if r["n"] >= 10:
                found[parser.languages.index(r["lang"])] = max(SLACK * r["cuts"][0], r["cuts"][1])
    return np.where(np.isnan(found), np.inf if np.isnan(found).all() else np.nanmax(found), found)


def in_languages(docs: DataFrame, parser: CrossParser, languages: list[str] | None = None, text_col: str = "text", most: np.ndarray | None = None) -> DataFrame:
    """The rows whose text is in one of the languages (by default, in any learned one); others, and texts without a letter, go.

    With `most` (see `limits`) texts of `LEAST_CHARS` or more that no language fits go too.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    wanted = set(parser.languages if languages is None else languages)
    shared = spark.sparkContext.broadcast((parser, most))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, most = shared.value
        for batch in found:
            texts = batch.column(text_col).to_pylist()
            if most is None:
                keep = [p[0] in wanted for p in parser.predict(texts)]
            else:
                keep = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool) & bool(parser.languages)
                if keep.any():
                    best, bits, sizes = parser.fit([plain(t) for t, k in zip(texts, keep) if k])
                    named = np.isin(best, [k for k, lang in enumerate(parser.languages) if lang in wanted])
                    keep[keep] = named & ((sizes < LEAST_CHARS) | (bits <= most[best]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
