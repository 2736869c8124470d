"""Licence scan: normalised text compared to licence templates by the Dice coefficient over word bigrams.

The units of a document are the whole text, its paragraphs and its lines. A unit is lower-cased, everything but letters and digits
becomes a space, and its distinct word bigrams are compared with those of each template: Dice = 2 |A and B| / (|A| + |B|). For a
threshold t this needs t/(2-t) <= |A|/|B| <= (2-t)/t, which prunes by size alone; a unit must also hold a bigram of some template.
The templates are a fixed small list and travel as a literal, so that a scan is one pass without a join, shuffle or Python code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Customary short notices of public licences.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct word bigrams; none for fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_table(df: DataFrame, templates: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """Each template with its bigrams, normalised by the same expressions as the documents."""
    spark = df.sparkSession
    rows = spark.createDataFrame(list(templates.items()), "licence string, text string")
    found = rows.select("licence", bigrams_of(words_of(F.col("text"))).alias("bigrams")).collect()  # the fixed list
    return sorted((r["licence"], sorted(r["bigrams"])) for r in found if r["bigrams"])


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_units, matches: one row per row of `docs`; matches lists (unit, number, licence, dice, text) of units that match.

    A unit takes the template of the highest coefficient, of equal ones the first by name. Units are `document`, `paragraph` (cut at
    empty lines) and `line`, each numbered from 0; a text of one line is one unit, not three, and likewise a paragraph of one line.
    Null and empty texts have no units. Repeated rows repeat in the result. Works for any id type, nulls included.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    table = template_table(docs, templates)
    if not table:
        raise ValueError("no template has two words")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = [len(b) for _, b in table]
    shrink, grow = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    low, high = shrink * min(sizes), grow * max(sizes)
    anchors = F.array(*[F.lit(b) for b in sorted({b for _, bigrams in table for b in bigrams})])
    known = F.array(
        *[F.struct(F.lit(name).alias("licence"), F.array(*[F.lit(b) for b in bigrams]).alias("bigrams")) for name, bigrams in table]
    )
    no_units = F.array().cast("array<struct<unit:string,number:bigint,text:string>>")
    lines = F.split("text", "\n")
    paragraphs = F.split("text", r"\n[ \t\r]*\n\s*")

    def units(kind: str, parts: Column, skip_single: bool) -> Column:
        listed = F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("number"), t.alias("text")))
        if not skip_single:
            return listed
        # A text without a line break is a line already.
        return F.filter(listed, lambda u: F.contains(u["text"], F.lit("\n")))

    every = F.concat(
        units("line", lines, False),
        F.when(F.size(paragraphs) > 1, units("paragraph", paragraphs, True)).otherwise(no_units),
        units("document", F.array(F.col("text")), True),
    )
    filled = F.filter(every, lambda u: F.trim(u["text"]) != "")
    shaped = texts.select("doc_id", F.coalesce(filled, no_units).alias("units"))
    # Size bounds first: words, then distinct bigrams, and only then the comparison.
    worded = F.transform(
        "units",
        lambda u: F.struct(u["unit"].alias("unit"), u["number"].alias("number"), u["text"].alias("text"), words_of(u["text"]).alias("words")),
    )
    with_words = shaped.select("doc_id", F.size("units").cast("long").alias("n_units"), F.filter(worded, lambda u: F.size(u["words"]) > low).alias("units"))
    with_grams = with_words.select(
        "doc_id",
        "n_units",
        F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), u["number"].alias("number"), u["text"].alias("text"), bigrams_of(u["words"]).alias("bigrams"))).alias("units"),
    )
    bounded = with_grams.select(
        "doc_id",
        "n_units",
        F.filter("units", lambda u: F.size(u["bigrams"]).between(low, high) & F.arrays_overlap(u["bigrams"], anchors)).alias("units"),
    )

    def judged(u: Column) -> Column:
        n = F.size(u["bigrams"])
        fits = F.filter(known, lambda t: n.between(shrink * F.size(t["bigrams"]), grow * F.size(t["bigrams"])))
        dice = F.transform(
            fits,
            lambda t: F.struct(
                (F.lit(-2.0) * F.size(F.array_intersect(u["bigrams"], t["bigrams"])) / (n + F.size(t["bigrams"]))).alias("minus"), t["licence"].alias("licence")
            ),
        )
        best = F.array_min(dice)
        return F.struct(u["unit"].alias("unit"), u["number"].alias("number"), best["licence"].alias("licence"), (-best["minus"]).alias("dice"), u["text"].alias("text"))

    scored = bounded.select("doc_id", "n_units", F.transform("units", judged).alias("matches"))
    return scored.select("doc_id", "n_units", F.filter("matches", lambda m: m["dice"] >= threshold).alias("matches"))
