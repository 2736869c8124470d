"""Token counts by section: whole documents are encoded once, and each token goes to the section its characters lie in.

Tokens of a byte-level vocabulary are byte strings, so the running sum of their lengths gives each token's span of bytes; sections
are spans of the same bytes. Spans and sections are both ordered, so that the interval join is a merge by binary search. A token
that crosses a boundary is allocated by an explicit rule:

* `start`: to the section that holds its first byte;
* `majority`: to the section that holds most of its bytes, of equal ones the earlier;
* `split`: to every section it touches, by its share of bytes (counts are then fractions).

A token that begins where no section is, but reaches into one, goes by its bytes inside sections; one outside all sections is counted
as left over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .subwords import rank_encoding, vocabulary_path

RULES = ("start", "majority", "split")

_ENCODINGS: dict[str, tuple] = {}


def _encoding(path: str) -> tuple:
    if path not in _ENCODINGS:
        encoding = rank_encoding(path)
        lengths = np.zeros(encoding.max_token_value + 1, np.int64)
        for token in encoding.token_byte_values():
            lengths[encoding.encode_single_token(token)] = len(token)
        _ENCODINGS[path] = encoding, lengths
    return _ENCODINGS[path]


def line_sections(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) of the lines, each with its line feed; none for an empty text."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.append(cuts, len(data))
    return starts[starts < ends], ends[starts < ends]


def allocate(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens of every section, crossing tokens that touch it, tokens left over).

    `ends` are the ends of the tokens, the first starting at 0; sections are ordered, don't overlap and aren't empty.
    """
    sections = len(starts_of)
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    if not sections or not len(ends):
        return np.zeros(sections), np.zeros(sections, np.int64), float(len(ends))
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(ends_of, starts, "right")  # the first section that ends after the token's start
    last = np.searchsorted(starts_of, ends, "left") - 1  # the last section that starts before its end
    touching = last >= first
    inside = touching & (first == last)
    counts = np.bincount(first[inside], minlength=sections).astype(float)
    crossing = np.zeros(sections, np.int64)
    wide = np.flatnonzero(touching & (first < last))
    for t in wide.tolist():  # only tokens that cross a boundary between sections
        own = np.arange(first[t], last[t] + 1)
        crossing[own] += 1
        shares = np.minimum(ends[t], ends_of[own]) - np.maximum(starts[t], starts_of[own])
        if rule == "split":
            counts[own] += shares / shares.sum()
        elif rule == "majority":
            counts[own[np.argmax(shares)]] += 1
        else:
            counts[own[0]] += 1
    return counts, crossing, float(len(ends) - touching.sum())


def section_counts(
    docs: DataFrame, rule: str = "majority", vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    sections: Callable[[bytes], tuple[np.ndarray, np.ndarray]] = line_sections,
) -> DataFrame:
    """doc_id, section, start_char, n_chars, n_tokens, n_crossing: one row for every section of every row.

    Sections are the lines by default, numbered from 0, with the line feed that ends them. Null and empty texts have no section and no
    row. Repeated rows repeat. Counts are fractions under the rule `split`, whole numbers otherwise.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    arrow_batches(docs.sparkSession, 512)
    where = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    names = ["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(where)
        for batch in found:
            per_doc, columns = [], [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])
                low, high = sections(data)
                counts, crossing, _ = allocate(ends, low, high, rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                per_doc.append(len(low))
                for column, values in zip(columns, (np.arange(len(low)), chars[low], chars[high] - chars[low], counts, crossing)):
                    column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0) for c in columns]
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), per_doc)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(flat, kinds)]], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, section long, start_char long, n_chars long, n_tokens double, n_crossing long")
