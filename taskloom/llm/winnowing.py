"""Benchmark decontamination by winnowing, in built-in functions only.

Of every `WINDOW` consecutive k-gram hashes (`GRAM` words each) the least is kept, in documents and in benchmark items alike. A span
of GRAM + WINDOW - 1 = 10 words that both share has the same k-grams, hence the same least hash: the guarantee. Kept hashes of
documents join those of the benchmark; each hit is extended to the windows of 10 words around it, and these are compared with the
benchmark's own windows word by word. So what is reported is exact, and nothing of 10 words or more is missed.

Only kept hashes that pass a bitmap of the benchmark's hashes leave a document row. The bitmap has `SLOTS_EACH` bytes for each of them, up to
`MAX_BITMAP`, and only spares work: the join decides. The benchmark's fingerprints and windows are broadcast while they are counted to
be few, and joined by a shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

LENGTH = 10
GRAM = 5
WINDOW = LENGTH - GRAM + 1
SLOTS_EACH = 32
MAX_BITMAP = 1 << 22
#: Benchmark windows up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000
#: Fixed value: what separates words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. `lower` is much the faster and equal where every character is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    upper = F.transform(
        F.split(F.coalesce(text, F.lit("")), SEPARATORS),
        lambda w: F.when(F.lower(w) == w, w).otherwise(ascii_lower(w)),
    )
    return F.filter(upper, lambda w: w != "")


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every k consecutive words, from the hashes of the words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - k)
    gram = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, gram).otherwise(F.array().cast("array<bigint>"))


def _least(grams: Column, window: int) -> Column:
    """Minimum of every `window` consecutive hashes."""
    if window == 1:
        return grams
    starts = F.sequence(F.lit(0), F.size(grams) - window)
    least = F.transform(starts, lambda i: F.least(*[F.get(grams, i + j) for j in range(window)]))
    return F.when(F.size(grams) >= window, least).otherwise(F.array().cast("array<bigint>"))


def _plan_of(length: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window for shared spans of so many words."""
    gram = min(GRAM, length)
    return gram, length - gram + 1


def _spans(words: Column, length: int) -> Column:
    """Every run of `length` words, space-joined."""
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " ")))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """item_id, length, span: every window of every item, a short item being one window of its own length."""
    own = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    own = own.withColumn("length", F.least(F.size("words"), F.lit(length)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    spans = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))
    return own.select("item_id", "length", F.explode(F.array_distinct(spans)).alias("span")).distinct()


def _bitmap(rows: DataFrame) -> tuple[Column, int]:
    """(a literal with one byte a slot, 1 where a hash of the benchmark falls; the number of slots)."""
    size = min(MAX_BITMAP, 1 << max(12, (SLOTS_EACH * rows.count()).bit_length()))
    slots = rows.select(F.pmod("hash", F.lit(size)).cast("int").alias("slot")).distinct()
    marks = bytearray(size)
    for row in slots.toLocalIterator():  # at most MAX_BITMAP small integers, a partition at a time
        marks[row["slot"]] = 1
    return F.lit(bytes(marks)), size


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, copies, n_words, hit_words (positions inside occurrences), spans (numbers of the windows that occur).

    One row for each distinct (id, text); `copies` counts the rows that repeat it. `windows` has window_id, length, span.
    """
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most LENGTH small integers
    few = windows.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    words = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words")
    )
    rows = rows.withColumns({"n_words": F.size("words"), "hashes": words})
    found, prints = [], []
    for length in lengths:
        gram, window = _plan_of(length)
        own = windows.where(F.col("length") == length)
        own_hashes = F.transform(F.split("span", " "), lambda w: F.xxhash64(w))
        own_prints = own.select(F.array_min(_grams(own_hashes, gram)).alias("hash")).distinct()
        prints.append(own_prints.select(F.lit(length).alias("length"), "hash"))
        marks, slots = _bitmap(own_prints)
        name = f"grams_{length}"
        rows = rows.withColumn(name, _grams(F.col("hashes"), gram))
        kept = F.array_distinct(F.filter(_least(F.col(name), window), lambda h: F.substring(marks, F.pmod(h, F.lit(slots)).cast("int") + 1, 1) == F.lit(b"\x01")))
        places = F.filter(F.sequence(F.lit(0), F.size(name) - 1), lambda i: F.array_contains(F.col(f"kept_{length}"), F.get(F.col(name), i)))
        rows = rows.withColumn(f"kept_{length}", kept)
        around = F.transform(
            F.when((F.size(f"kept_{length}") > 0), places).otherwise(F.array().cast("array<int>")),
            # The words of the windows that hold the k-gram, and where the first of them starts.
            lambda p: F.struct(
                F.lit(length).alias("length"),
                F.get(F.col(name), p).alias("hash"),
                F.greatest(p - (window - 1), F.lit(0)).alias("start"),
                F.slice(F.col("words"), F.greatest(p - (window - 1), F.lit(0)) + 1, gram + window - 1 + F.least(p, F.lit(window - 1))).alias("near"),
            ),
        )
        found.append(around)
    keys = ["doc_id", "mark", "n_words"]
    if not lengths:
        plain = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        return plain.withColumns({"hit_words": F.array().cast("array<int>"), "spans": F.array().cast("array<bigint>")})
    candidates = rows.select(*keys, F.posexplode_outer(F.concat(*found)).alias("place", "cand"))
    candidates = candidates.select(*keys, (F.coalesce("place", F.lit(0)) == 0).cast("long").alias("row"), "cand.*")
    all_prints = prints[0]
    for more in prints[1:]:
        all_prints = all_prints.unionByName(more)
    shared = candidates.join(small(all_prints.withColumn("shared", F.lit(True))), ["length", "hash"], "left")
    size = F.size("near") - F.col("length") + 1
    starts = F.when(F.col("shared") & (size > 0), F.sequence(F.lit(1), size))
    extended = F.transform(starts, lambda i: F.struct((F.col("start") + i - 1).alias("at"), F.array_join(F.slice("near", i, F.col("length")), " ").alias("span")))
    spans = shared.select(*keys, "row", "length", F.posexplode_outer(extended).alias("nth", "w"))
    spans = spans.select(*keys, F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("row")).otherwise(F.lit(0)).alias("row"), "length", "w.at", "w.span")
    matched = spans.join(small(windows.select("length", "span", "window_id")), ["length", "span"], "left")
    at = F.when(F.col("window_id").isNotNull(), F.struct("at", "length"))
    grouped = matched.groupBy(*keys).agg(F.sum("row").alias("copies"), F.collect_set(at).alias("at"), F.collect_set("window_id").alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    return grouped.select(*keys, "copies", covered.alias("hit_words"), "spans")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, mark, n_words, hit_words, item_ids (sorted as strings), contaminated, of every row of `docs`.

    Null and empty texts have no words and no hits; items without a word count for nothing; rows that repeat stay as often as they
    come, and rows of one id with different texts are judged each on its own. `mark` is xxhash64 of the text.
    """
    owned = staged(benchmark_windows(items, length=length).withColumn("window_id", F.xxhash64("length", "span")), "windows")
    # Read twice below, and narrow: written once.
    found = staged(hits(docs, owned.select("window_id", "length", "span").distinct(), id_col, text_col), "hits")
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    named = found.select("doc_id", "mark", F.explode("spans").alias("window_id")).join(owned.select("window_id", "item_id"), "window_id")
    named = named.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    named = named.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "item_ids")
    joined = copies.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "mark", "n_words", "hit_words", F.coalesce("item_ids", none).alias("item_ids"), (F.size("hit_words") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a window of the benchmark."""
    owned = staged(benchmark_windows(items).withColumn("window_id", F.xxhash64("length", "span")), "windows")
    found = hits(docs, owned.select("window_id", "length", "span").distinct(), id_col, text_col)
    bad = staged(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "leaks")
    # The rows as one column: no name of theirs meets one used here.
    own = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"))
    hit = F.col("own_id").eqNullSafe(F.col("_id")) & F.col("own_mark").eqNullSafe(F.col("_mark"))
    return own.join(bad, hit, "left_anti").select("own_row.*")
