import random

from cases import ODD, make_docs  # noqa: F401
from test_simhash import brute_print

from taskloom.llm import shingles, simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_sets_and_sizes_against_brute_force():
    for _, text in ODD:
        assert len(shingles.shingle_set(text)) == len(brute_set(text))


def test_stage_finds_every_pair_of_likeness_08(make_docs):  # noqa: F811
    """Classes are those of all pairs at 0.8 or at three bits, near copies that share no leader and a chain among them."""
    rng = random.Random(4)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts += [" ".join(words)] + [edited(rng, words, rng.randrange(1, 2 + len(words) // 25)) for _ in range(3 if k else 60)]
        last = words
        for _ in range(4):
            last = edited(rng, last, 1 + len(last) // 60).split()
            texts.append(" ".join(last))
    docs = list(enumerate(texts)) + [(None if d is None else 1000 + d, t) for d, t in ODD if t is None or len(t) < 5000]
    sets, prints = [brute_set(t) for _, t in docs], [brute_print(t) for _, t in docs]
    root, missed = list(range(len(docs))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near, close = both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both), (prints[i] ^ prints[j]).bit_count() <= 3
            missed += bool(near and not close)
            if near or close:
                root[find(i)] = find(j)
    assert missed > 100
    best = {}
    for i, (d, _) in enumerate(docs):
        best.setdefault(find(i), []).append((d is None, d or 0))
    kept = simhash.deduplicated(make_docs(docs), similar=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(v) for v in best.values())


def test_small_sets_and_groups_that_no_leader_holds(make_docs):  # noqa: F811
    """Equal sets of few shingles are linked; in a group around one text, heavily edited ones are linked with whom they are near and only them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    heavy = [edited(rng, base, rng.randrange(4, 8)) for _ in range(40)]
    texts = ["a b a b a b", "a b a b a b a", "c d"] + [edited(rng, base, rng.randrange(1, 5)) for _ in range(80)] + heavy
    texts += [" ".join(t.split()[:-1] + ["z"]) for t in heavy[:5]]
    sets, prints, root = [brute_set(t) for t in texts], [brute_print(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert len({find(i) for i in range(len(texts))}) > 5
    kept = simhash.deduplicated(make_docs(list(enumerate(texts))), similar=True).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))})


def test_prefix_filter_finds_every_near_pair(spark, monkeypatch):
    """All pairs of 0.8 among sets of many sizes, whatever the bits say."""
    monkeypatch.setattr(shingles, "APART", 10**6)
    rng = random.Random(3)
    sets = []
    for _ in range(25):
        own = rng.sample(range(400), rng.randrange(1, 60))
        sets.append(set(own))
        for _ in range(3):
            sets.append((set(own) - set(rng.sample(own, min(len(own) - 1, rng.randrange(0, 1 + len(own) // 6))))) | set(rng.sample(range(400), rng.randrange(0, 1 + len(own) // 8))))
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "copy long, shingles array<long>")
    texts = spark.createDataFrame([(i, i, len(s), [0] * 6) for i, s in enumerate(sets)], "copy long, root long, size int, bits array<long>")
    found = {(r.copy, r.other) for r in shingles._prefix_pairs(texts, frame).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near and near <= found and len(found) < len(sets) * (len(sets) - 1) / 4
