import hashlib
import random
import re

from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    found |= own
                    hit |= set(range(s, s + n))
        names = ",".join(sorted(str(i) for i in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found_by(df):
    rows = df.collect()
    return sorted(
        ((r.doc_id, r.n_words, len(r.hit_words), len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in rows), key=str
    )


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten"),
    (11, "two three four five six seven eight nine ten eleven"),
    (2, "x"),
    (3, None),
    (4, "..."),
    (5, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor"),
    (6, "tower 😀 emoji"),
    (None, "the same number"),
]


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_documents_and_short_items(spark, make_docs):
    docs = [(d, t if t is None or len(t) < 10_000 else t[:6000]) for d, t in ODD]
    named = [i for i in ITEMS if i[0] is not None]
    found = winnowing.contamination(make_docs(docs), items_frame(spark, named))
    assert found_by(found) == brute(docs, named)


def test_random_spans_of_few_words_against_brute_force(spark, make_docs):
    """A small vocabulary gives many partial overlaps and ties of hashes."""
    rng = random.Random(1)
    text = lambda n, v: " ".join(rng.choice("abcdefghij"[:v]) for _ in range(n))
    items = [(i, text(rng.randrange(3, 30), rng.choice((2, 10)))) for i in range(25)]
    docs = [(i, text(rng.randrange(0, 60), rng.choice((2, 10)))) for i in range(60)]
    docs += [(100 + i, f"{text(5, 10)} {items[i][1]} {text(7, 10)}, {items[i + 1][1]}") for i in range(15)]
    assert found_by(winnowing.contamination(make_docs(docs), items_frame(spark, items))) == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, make_docs, monkeypatch):
    docs = [(i, " ".join(f"w{(i + j) % 40}" for j in range(30))) for i in range(40)]
    items = [(i, " ".join(f"w{(3 * i + j) % 40}" for j in range(12))) for i in range(10)]
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    assert found_by(winnowing.contamination(make_docs(docs), items_frame(spark, items))) == brute(docs, items)


def test_decontaminated_keeps_the_clean(spark, make_docs):
    docs = [(d, t if t is None or len(t) < 10_000 else t[:6000]) for d, t in ODD]
    named = [i for i in ITEMS if i[0] is not None]
    dirty = {r[0] for r in brute(docs, named) if r[-1]}
    kept = winnowing.decontaminated(make_docs(docs), items_frame(spark, named))
    clean = [d for d in docs if not brute([d], named)[0][-1]]
    assert dirty and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert kept.columns == make_docs([]).columns


def test_nothing_to_find(spark, make_docs):
    none = items_frame(spark, [(1, ""), (2, None)])
    found = winnowing.contamination(make_docs([(1, "a b"), (2, None)]), none)
    assert found_by(found) == brute([(1, "a b"), (2, None)], [])
    assert winnowing.contamination(make_docs([]), items_frame(spark, ITEMS[:2])).count() == 0
    assert winnowing.decontaminated(make_docs([(1, "a")]), items_frame(spark, [])).count() == 1
