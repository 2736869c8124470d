import random

import xxhash
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Least id reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        r = find(i)
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((d, f"{p:016x}", least[find(i)]) for i, (d, p) in enumerate(prints)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprint_is_the_majority_of_shingle_bits():
    for _, text in ODD:
        assert simhash.simhash(text) == brute_print(text)


def test_odd_documents_against_all_pairs(make_docs):
    expected = brute_classes([(d, brute_print(t)) for d, t in ODD])
    assert rows_of(simhash.near_duplicates(make_docs(ODD))) == expected


def test_classes_of_random_neighbours_against_all_pairs(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        prints.append(centre)
        for _ in range(rng.randrange(5)):  # chains of up to four flipped bits at a time
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            prints.append(centre)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {r["fp"]: r["root"] for r in simhash.classes(spark.createDataFrame(signed, "fp long")).collect()}
    assert len(found) == len(set(prints))
    expected = {int(p, 16): r for _, p, r in brute_classes(list(enumerate(prints)))}
    groups = {}
    for (fp,), plain in zip(signed, prints):
        groups.setdefault(found[fp], set()).add(expected[plain])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))


def test_one_dense_group_stays_linear(spark):
    """Every fingerprint within two bits of a centre: all in one class, and the far step meets no one."""
    centre = 0x0123456789ABCDEF
    prints = [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    signed = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    assert simhash.near_links(signed).count() <= 65 * len(prints)
    assert simhash.classes(signed).select("root").distinct().count() == 1


def test_deduplicated_leaves_one_of_each_class(make_docs):
    kept = simhash.deduplicated(make_docs(ODD))
    assert kept.columns == make_docs([]).columns
    found = rows_of(kept.select("doc_id", "text"))
    classes = brute_classes([(d, brute_print(t)) for d, t in ODD])
    prints = {(d, t): brute_print(t) for d, t in found}
    assert len(found) == len(set(prints.values()))
    assert len(found) == len({(c, p) for _, p, c in classes if True and p in {f"{x:016x}" for x in prints.values()}})
    assert (1, None) in found and (2, "") not in found and (3, "   \n\t ") not in found
    assert (None, "a text without a number") in found


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.deduplicated(make_docs([])).count() == 0
