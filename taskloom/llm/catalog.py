"""The queries of this folder's operators, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path
from . import attention_lm, bitplanes, collocations, langid, licences, packing, simhash, suffixdedup, syncmers, tokencounts, toxicity, vectorcodes, winnowing
from .common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as bytes with one end each, packed into sequences of 1,024 to 8,192."""
    documents = read_table(configure(spark), sf_dir, "documents")
    return packing.packed(documents, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(read_table(configure(spark), sf_dir, "documents"))


def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(configure(spark), sf_dir, "documents"))


def op4_attention_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.corpus_scores(read_table(configure(spark), sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document: how many units were looked at and matched, the licences, the best coefficient."""
    found = licences.scan(read_table(configure(spark), sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_units",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def op6_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(configure(spark), "token-ids")
    bitplanes.write_ids(read_table(spark, sf_dir, "documents"), path)
    return bitplanes.document_digests(spark, path)


def op7_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(read_table(configure(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(read_table(configure(spark), sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(configure(spark), sf_dir, "documents"))


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses lines goes where most of its bytes are."""
    return tokencounts.section_counts(read_table(configure(spark), sf_dir, "documents"), "majority")


def op11_prefix_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.without_repeats(read_table(configure(spark), sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_resident_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(read_table(configure(spark), sf_dir, "embeddings"))


def op13_parse_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(configure(spark), sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(configure(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_syncmer_fingerprints, op3_cross_parsing_language, op4_attention_lm_scores, op5_licence_scan,
        op6_bitplane_ids, op7_toxicity_bigru, op8_winnowing_decontamination, op9_simhash_duplicates, op10_token_attribution,
        op11_prefix_doubling_repeats, op12_resident_lloyd_codes, op13_parse_collocations, pipeline,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Every unit of every document against every template, without any pruning."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(licences.TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    WITH templates AS (SELECT licence, {grams.format('w')} AS g FROM (SELECT licence, {words.format('t')} AS w FROM (VALUES {values}) v(licence, t))),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    units AS (
      SELECT r, unnest(string_split(text, chr(10))) AS t FROM docs WHERE text IS NOT NULL
      UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) AS p, len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) AS n FROM docs WHERE text IS NOT NULL)
        WHERE n > 1 AND contains(p, chr(10))
      UNION ALL SELECT r, text FROM docs WHERE contains(text, chr(10))),
    grams AS (SELECT r, {grams.format('w')} AS g FROM (SELECT r, {words.format('t')} AS w FROM units WHERE trim(t) <> '')),
    counted AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
    pairs AS (
      SELECT r, u, licence, 2.0 * len(list_intersect(grams.g, templates.g)) / (len(grams.g) + len(templates.g)) AS dice
      FROM (SELECT r, row_number() OVER () AS u, g FROM grams) grams, templates WHERE len(grams.g) > 0),
    best AS (SELECT r, u, max(dice) AS dice, min_by(licence, (-dice, licence)) AS licence FROM pairs GROUP BY r, u HAVING max(dice) >= {licences.THRESHOLD}),
    found AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS dice FROM best GROUP BY r)
    SELECT doc_id, coalesce(c.n, 0) AS n_units, coalesce(f.n, 0) AS n_matches, coalesce(f.licences, '') AS licences,
      round(coalesce(f.dice, 0), 6) AS best_dice
    FROM docs LEFT JOIN counted c USING (r) LEFT JOIN found f USING (r)"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def leak_ctes(documents: str) -> str:
    """Common tables with every occurrence of a benchmark window in a table of documents: `d` (r, w), `hit` (r, item_id, s, n)."""
    return f"""
    i AS (SELECT item_id, w, least(len(w), {winnowing.LENGTH}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    spans AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS span FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
    d AS (SELECT row_number() OVER () AS r, *, {_WORDS} AS w FROM {documents}),
    places AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS span
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM spans))),
    hit AS (SELECT r, item_id, s, n FROM places JOIN spans USING (n, span))"""


_LEAKS = f"""
    WITH {leak_ctes('documents')},
    words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
    items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_PHRASES = f"""
    WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS c
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m) GROUP BY ALL),
    totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    often AS (SELECT lang, m, phrase, c, string_split(phrase, ' ') AS w FROM f WHERE c >= {collocations.LEAST}),
    cuts AS (SELECT lang, m, phrase, c, w, unnest(range(1, m)) AS k FROM often WHERE m > 1),
    scored AS (SELECT cuts.lang, cuts.phrase, cuts.c AS a, k, l.c AS l, r.c AS r, (2000000::HUGEINT * cuts.c) // (l.c::HUGEINT + r.c) AS score
      FROM cuts JOIN often l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1 : k], ' ')
      JOIN often r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[k + 1 : cuts.m], ' ')),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(c) AS c
      FROM (SELECT lang, m, w, c, j, unnest(range(1, m - j + 2)) AS i FROM often, (VALUES (2), (3)) v(j) WHERE j < m) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(worst.phrase)) AS rank, worst.phrase, a, l, r, n, score::BIGINT AS score
    FROM worst JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
    WHERE longer.c IS NULL OR 100::HUGEINT * longer.c < {collocations.SHARE} * a::HUGEINT
    QUALIFY rank <= {collocations.TOP}"""

_MOVED = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _lloyd_sql() -> str:
    """Two rounds, each as an assignment and new entries, and the last assignment."""

    def assignment(i: int) -> str:
        return f"""
    a{i} AS MATERIALIZED (SELECT rid, p, part, min(dist * {vectorcodes.ENTRIES} + e) % {vectorcodes.ENTRIES} AS e, min(dist) AS dist
      FROM (SELECT rid, parts.p, parts.part, e, {_MOVED.format('parts.part', f'b{i}.part')} AS dist FROM parts JOIN b{i} USING (p)) GROUP BY rid, p, part)"""

    def entries(i: int) -> str:
        return f"""
    m{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM (
      SELECT p, e, i, sum(part[i]) AS s, count(*) AS n FROM (SELECT p, e, part, unnest(range(1, len(part) + 1)) AS i FROM a{i}) GROUP BY ALL) GROUP BY p, e),
    b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.part, b{i}.part) AS part FROM b{i} LEFT JOIN m{i} USING (p, e))"""

    steps = ",".join(f"{assignment(i)},{entries(i)}" for i in range(vectorcodes.ROUNDS))
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * x::DOUBLE)::BIGINT) AS q
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT rid, vec_id, p, q[p * (len(q) // {vectorcodes.PARTS}) + 1 : (p + 1) * (len(q) // {vectorcodes.PARTS})] AS part
      FROM kept, range({vectorcodes.PARTS}) t(p)),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part FROM parts
      WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {vectorcodes.ENTRIES})),{steps},{assignment(vectorcodes.ROUNDS)},
    coded AS (SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{vectorcodes.ROUNDS} GROUP BY rid),
    book AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS digest FROM b{vectorcodes.ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded USING (rid), book"""


#: The others are learnt, hashed or sequential; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op5_licence_scan": _licence_sql(),
    "op8_winnowing_decontamination": _LEAKS,
    "op12_resident_lloyd_codes": _lloyd_sql(),
    "op13_parse_collocations": _PHRASES,
}
