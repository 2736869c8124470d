import random

import numpy as np
import pytest
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import subwords, tokencounts

PATH = subwords.vocabulary_path("byte_bpe_50k.tiktoken")


def brute(ends, sections, rule):
    counts, crossing, left, begin = [0.0] * len(sections), [0] * len(sections), 0, 0
    for end in ends:
        shares = {i: len(set(range(begin, end)) & set(range(a, b))) for i, (a, b) in enumerate(sections)}
        shares = {i: n for i, n in shares.items() if n}
        begin = end
        if not shares:
            left += 1
            continue
        if len(shares) > 1:
            for i in shares:
                crossing[i] += 1
        if rule == "split":
            for i, n in shares.items():
                counts[i] += n / sum(shares.values())
        elif rule == "majority":
            counts[max(shares, key=lambda i: (shares[i], -i))] += 1
        else:
            counts[min(shares)] += 1
    return counts, crossing, left


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_allocation_against_every_byte(rule):
    rng = random.Random(1)
    for _ in range(150):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(0, 20))]).astype(int)
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(0, 6)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        if rng.random() < 0.5:  # side by side
            cuts = [0, *sorted(rng.sample(range(1, 60), 4))]
            sections = list(zip(cuts, cuts[1:]))
        low, high = np.array([a for a, _ in sections], int), np.array([b for _, b in sections], int)
        counts, crossing, left = tokencounts.allocate(ends, low, high, rule)
        expected = brute(ends.tolist(), sections, rule)
        assert np.allclose(counts, expected[0]) and crossing.tolist() == expected[1] and left == expected[2]


def expected_rows(docs, rule):
    encoding, out = subwords.rank_encoding(PATH), []
    for doc_id, text in docs:
        data = (text or "").encode()
        ends = np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(text or "")]).tolist()
        lines = data.split(b"\n")
        lines = [line + b"\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        sections, at = [], 0
        for line in lines:
            sections.append((at, at + len(line)))
            at += len(line)
        counts, crossing, left = brute(ends, sections, rule)
        assert left == 0
        chars = 0
        for i, line in enumerate(lines):
            n = len(line.decode())
            out.append((doc_id, i, chars, n, round(counts[i], 9), crossing[i]))
            chars += n
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_odd_documents_by_line(make_docs, rule):  # noqa: F811
    docs = [(d, t if t is None or len(t) < 5000 else t[:1500]) for d, t in ODD]
    docs += [(20, "a\n\n\n\nb\n \n  c\n"), (21, "é東\n😀\n\n\n"), (22, "\n")]
    rows = tokencounts.section_counts(make_docs(docs), rule).collect()
    assert sorted(((*r[:4], round(r[4], 9), r[5]) for r in rows), key=str) == expected_rows(docs, rule)


def test_counts_add_up_over_a_long_text(make_docs):  # noqa: F811
    text = "lorem ipsum\n\n dolor sit amet. " * 20_000
    rows = tokencounts.section_counts(make_docs([(1, text)])).collect()
    assert sum(r.n_tokens for r in rows) == len(subwords.rank_encoding(PATH).encode_ordinary(text))
    assert sum(r.n_chars for r in rows) == len(text)


def test_empty_table_and_rule(make_docs):  # noqa: F811
    assert tokencounts.section_counts(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        tokencounts.section_counts(make_docs([]), "end")
