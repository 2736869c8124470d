"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from cases import DOCS, ODD, make_docs  # noqa: F401

from taskloom.llm import collocations
from taskloom.llm.bytetext import flat_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for row in rows:
        lang = (row[2] if len(row) > 2 else None) or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (row[1] or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered[p[i : i + n]], a)
        kept = []
        for p, a in often.items():
            if 100 * covered[p] >= share * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def check(docs, rows, least=30, share=80, top=2000):
    found = collocations.collocations(docs, least=least, share=share, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, share, top)


def texts(rng, n):
    words = ["of", "the", "New", "york", "city", "é", "naïve", "東京", "a", "b", "c", "x-y"]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["new york city hall", "of the"] + words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]))
        yield (i, "".join(parts), rng.choice(["en", "de", None, "und"]))


@pytest.mark.parametrize("least, share, top", [(3, 80, 2000), (10, 50, 7), (1, 100, 10**6)])
def test_equals_counts_of_all_phrases(make_docs, least, share, top):  # noqa: F811
    rows = list(texts(random.Random(least), 60))
    rows += rows[:9]  # repeated rows count each
    check(make_docs(rows), rows, least, share, top)


def test_odd_documents(make_docs):  # noqa: F811
    rows = [*ODD, (9, "a b. c d\x0be f;g h " * 50, "fr")]
    check(make_docs(rows), rows, least=2)


def test_full_bitmap_changes_nothing(make_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    rows = list(texts(random.Random(2), 40))
    check(make_docs(rows), rows, least=4)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("trigger", [1, 3, 10**9])
def test_own_words_are_the_text(trigger):
    """The own words of all chunks are the words of the texts, and each overlap is what follows in the same piece."""
    rng = random.Random(trigger)
    rows = [t for _, t, _ in texts(rng, 30)] + ["", " ", "\n.\n"]
    flat, starts, ends = flat_bytes(pa.array(rows))
    chunks, own, of = collocations.parsed(collocations.Words(collocations._FOLD[flat], starts, ends), trigger, 3)
    said = defaultdict(list)
    for chunk, n, text in zip(chunks.to_pylist(), own.tolist(), of.tolist()):
        words = re.findall("[^ \n]+", chunk)
        said[text] += words[:n]
        assert len(words) - n <= 3
    folded = [re.findall(r"[^\s.,;:!?]+", t.translate(LOWER)) for t in rows]
    assert [said[i] for i in range(len(rows))] == folded


def test_slices_do_not_show(make_docs, monkeypatch):  # noqa: F811
    rows = list(texts(random.Random(3), 20))
    want = Counter(tuple(w) for r in rows for p in re.split("[.,;:!?\x0a-\x0d]", r[1].translate(LOWER)) for w in zip(*[re.findall("[^\x20\x09]+", p)[k:] for k in range(2)]))
    monkeypatch.setattr(collocations, "SLICE", 64)
    flat, starts, ends = flat_bytes(pa.array([r[1] for r in rows]))
    got = Counter()
    for some, begins, stops, _ in collocations._slices(collocations._FOLD[flat], starts, ends):
        chunks, own, _ = collocations.parsed(collocations.Words(some, begins, stops), 4, 3)
        for chunk, n in zip(chunks.to_pylist(), own.tolist()):
            at = 0
            for piece in chunk.split("\n"):
                words = piece.split(" ")
                got.update(tuple(words[i : i + 2]) for i in range(len(words) - 1) if at + i < n)
                at += len(words)
    assert got == want
