import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import langid

SYLLABLES = {"aa": "ka lo mi tu ne sa".split(), "bb": "thr ost igh ung ach elt".split(), "cc": "ción ñar lle que ado ez".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def brute_phrases(text, sample):
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + size] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_longest_matches(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(langid, "STRETCH", 40)
    samples = {lang: speak(rng, lang, 60) for lang in SYLLABLES}
    parser = langid.build(samples)
    texts = [langid.plain(speak(rng, rng.choice(sorted(SYLLABLES)), rng.randrange(1, 40)) + rng.choice(["", " zzz 東京", "xq"])) for _ in range(12)] + [""]
    found, sizes = parser.phrases(texts)
    for text, row, n in zip(texts, found.tolist(), sizes.tolist()):
        assert n == len(text)
        stretches = [text[i : i + 40] for i in range(0, len(text), 40)]
        assert row == [sum(brute_phrases(s, samples[k]) for s in stretches) for k in parser.languages]


def test_suffix_automaton_holds_all_substrings():
    rng = random.Random(9)
    codes = [rng.randrange(3) for _ in range(80)]
    steps = langid.suffix_automaton(codes)
    assert len(steps) <= 2 * len(codes)

    def holds(part):
        state = 0
        for c in part:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    own = {tuple(codes[i:j]) for i in range(80) for j in range(i + 1, min(81, i + 6))}
    for _ in range(400):
        part = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6)))
        assert holds(part) == (part in own)


def test_bits_and_score_by_formula():
    rng = random.Random(3)
    samples = {lang: speak(rng, lang, 200) for lang in SYLLABLES}
    parser = langid.build(samples)
    text = speak(rng, "bb", 20)
    own = langid.plain(text)
    bits = {k: brute_phrases(own, samples[k]) * math.log2(len(samples[k])) / len(own) for k in samples}
    lang, score, best = parser.predict([text])[0]
    assert lang == "bb" and best == pytest.approx(bits["bb"]) and 0.99 < score <= 1


def labelled(n=90):
    rng = random.Random(5)
    return [(i, speak(rng, lang := sorted(SYLLABLES)[i % 3], rng.randrange(30, 80)), lang if i % 10 else None) for i in range(n)]


def test_held_out_accuracy(make_docs):  # noqa: F811
    docs = labelled()
    rows = {r.doc_id: r for r in langid.identify(make_docs(docs)).collect()}
    assert {r.held_out for r in rows.values()} == {True, False}
    assert all(rows[i].lang_pred == sorted(SYLLABLES)[i % 3] and 0 <= rows[i].score <= 1 for i, *_ in docs)


def test_odd_documents(make_docs):  # noqa: F811
    rows = langid.identify(make_docs([*labelled(), *[(None if d is None else d + 1000, t) for d, t in ODD]])).collect()
    assert len(rows) == 90 + len(ODD)
    for r in rows:
        if r.doc_id in (1001, 1002, 1003):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0.0, None)
        else:
            assert r.lang_pred != "und" or r.doc_id is None


def test_repeated_rows_and_ids_of_held_out_rows_teach_nothing(make_docs):  # noqa: F811
    """A label that only held-out rows carry is never predicted."""
    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = [(i, "mmm nnn " * 20, "zz" if i in held else "aa") for i in range(200)]
    assert {r.lang_pred for r in langid.identify(make_docs(docs)).collect()} == {"aa"}


HAN = {k: [chr(low + i * 7 + j * 3) for i in range(900) for j in range(2)] for k, low in (("han", 0x4E00), ("more", 0x20000), ("kana", 0x4E03))}


def write(rng, lang, n):
    """Texts of words of two characters over some 1,800 characters; "han" and "kana" share half of theirs."""
    return "".join(HAN[lang][i] + HAN[lang][i + 1] for i in (min(int(rng.expovariate(1 / 250)), 1790) for _ in range(n)))


@pytest.mark.parametrize("seed", range(3))
def test_phrases_of_many_characters_are_longest_matches(seed):
    rng = random.Random(seed)
    samples = {k: write(rng, k, 400) for k in HAN} | {"aa": speak(rng, "aa", 60)}
    parser = langid.build(samples)
    texts = [langid.plain(write(rng, k, 60) + speak(rng, "aa", 3)) for k in HAN for _ in range(3)]
    found, unseen, _ = parser.parsed(texts)
    for text, row, lost in zip(texts, found.tolist(), unseen.tolist()):
        assert row == [brute_phrases(text, samples[k]) for k in parser.languages]
        assert lost == [sum(c not in samples[k] for c in text) for k in parser.languages]


def test_scripts_of_many_characters_and_unequal_samples():
    rng = random.Random(8)
    samples = {"han": write(rng, "han", 6000), "more": write(rng, "more", 3000), "kana": write(rng, "kana", 1500), "aa": speak(rng, "aa", 200)}
    parser = langid.build(samples)
    texts = [(k, write(rng, k, 60)) for k in HAN for _ in range(10)] + [("aa", speak(rng, "aa", 20)) for _ in range(10)]
    assert [p[0] for p in parser.predict([t for _, t in texts])] == [k for k, _ in texts]


def test_a_label_with_a_few_characters_wins_nowhere():
    rng = random.Random(9)
    parser = langid.build({lang: speak(rng, lang, 3000) for lang in SYLLABLES} | {"one": "a", "two": "ka lo", "stray": "thrigh ka"})
    for lang in SYLLABLES:
        assert {p[0] for p in parser.predict([speak(rng, lang, 40) for _ in range(20)])} == {lang}


def test_a_language_that_is_nearly_all_copies_is_learned(make_docs):  # noqa: F811
    rng = random.Random(6)
    hot = speak(rng, "bb", 50)
    docs = [(i, hot, "bb") for i in range(6000)] + [(7000 + i, speak(rng, "bb", 50), "bb") for i in range(40)] + [(8000 + i, speak(rng, "aa", 50), "aa") for i in range(40)]
    parser = langid.train(make_docs(docs), sample_chars=2400, total_chars=4800)
    assert parser.languages == ["aa", "bb"] and min(2**parser.weights) > 2000


def test_in_languages(make_docs):  # noqa: F811
    docs = make_docs([*labelled(), (900, "123 !!"), (901, None)])
    parser = langid.train(docs)
    kept = langid.in_languages(docs, parser)
    assert kept.columns == docs.columns and kept.count() == 90
    assert langid.in_languages(docs, parser, ["aa"]).count() == 30


def test_texts_that_no_learned_language_fits_go(make_docs):  # noqa: F811
    rng = random.Random(11)
    other = "zwo fy qer dhu vax pij".split()
    docs = [(i, speak(rng, lang := sorted(SYLLABLES)[i % 3], rng.randrange(30, 120)), lang) for i in range(400)]
    mixed = [(500 + i, speak(rng, "aa", 40) + " " + speak(rng, "bb", 40), "aa") for i in range(20)]
    unlearned = [(600 + i, " ".join("".join(rng.choice(other) for _ in range(rng.randrange(1, 4))) for _ in range(90)), ["aa", None][i % 2]) for i in range(20)]
    gibberish = [(700 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(90)), None) for i in range(20)]
    script = [(800 + i, write(rng, "more", 200), None) for i in range(5)]
    frame = make_docs(docs + mixed + unlearned + gibberish + script + [(900, "123"), (901, None), (902, "short and foreign")])
    parser = langid.train(make_docs(docs[:270]))
    most = langid.limits(make_docs(docs[270:]), parser)
    kept = langid.in_languages(frame, parser, most=most)
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs + mixed} | {902}
    assert langid.in_languages(frame, parser, ["bb"], most=most).where("doc_id < 400").count() == len([d for d in docs if d[2] == "bb"])


def test_all_labelled_text_is_counted(make_docs, monkeypatch):  # noqa: F811
    """Words anywhere in any text count, copies once; the dictionary takes the most frequent ones of the whole."""
    rng = random.Random(12)
    docs = [(i, "Often, %s " % "".join(rng.choice("abcdef") for _ in range(5)) + speak(rng, "aa", rng.randrange(20, 300)), "aa") for i in range(150)]
    docs += [(400 + i, docs[0][1], "aa") for i in range(300)] + [(800, None, "aa"), (801, "no language", None), (802, "12", "bb"), (803, "東" * 30, "cc")]
    counts = Counter(w for t in {t for _, t, k in docs if k == "aa" and t} for w in langid.plain(t).split())
    found = {(r.lang, r.word): r.n for r in langid.word_counts(make_docs(docs)).collect()}
    assert found == {("aa", w): n for w, n in counts.items()} | {("cc", "東" * 4): 7, ("cc", "東東"): 1}
    built = []
    monkeypatch.setattr(langid, "build", built.append)
    langid.train_on_all(make_docs(docs), sample_chars=300)
    words = " ".join(sorted(counts, key=lambda w: (-counts[w], w)))
    assert built == [{"aa": words[:300], "cc": "東東東東 東東"}] and "often" in words[:300]


def test_limits_are_those_of_all_held_out_text(make_docs):  # noqa: F811
    rng = random.Random(13)
    parser = langid.build({k: speak(rng, k, 300) for k in SYLLABLES})
    docs = [(i, speak(rng, k, rng.randrange(300, 900)) + (" " + speak(rng, "cc", 60) if i % 9 == 0 else ""), k) for k in ("aa", "bb") for i in range(60)]
    found = langid.limits(make_docs([*docs, *docs[:20], (900, None, "aa"), (901, "short", "aa"), (902, docs[0][1], "zz")]), parser)
    for k, lang in enumerate(("aa", "bb")):
        _, bits, _ = parser.fit([langid.plain(t) for _, t, own in docs if own == lang])
        assert found[k] == pytest.approx(max(langid.SLACK * sorted(bits)[29], sorted(bits)[59]))
    assert found[2] == max(found[:2])


def test_frequent_words_tell_languages_apart(make_docs):  # noqa: F811
    rng = random.Random(14)
    parser = langid.train_on_all(make_docs(labelled()))
    for lang in SYLLABLES:
        assert {p[0] for p in parser.predict([speak(rng, lang, 40) for _ in range(20)])} == {lang}
    assert langid.train_on_all(make_docs([(1, None, "aa"), (2, "x")])).languages == []


def test_no_labels_and_no_rows(make_docs):  # noqa: F811
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "text"), (2, None)])).collect()} == {"und"}
    assert langid.identify(make_docs([])).count() == 0


def test_memory_of_a_batch_is_that_of_a_part_of_it(monkeypatch):
    rng = random.Random(9)
    parser = langid.build({k: langid.plain(speak(rng, k, 2000)) for k in SYLLABLES})
    texts = [langid.plain(speak(rng, rng.choice(sorted(SYLLABLES)), n)) for n in (0, 1, 900, 40, 3000, 7) * 30]
    whole = [parser.parsed(texts), parser.fit(texts)]
    monkeypatch.setattr(langid, "PARSED_CHARS", 20_000)
    assert sum(map(len, texts)) > 20 * langid.PARSED_CHARS
    tracemalloc.start()
    parts = [parser.parsed(texts), parser.fit(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(map(len, texts))  # the codes of all texts alone
    for a, b in zip(whole, parts):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert [len(x) for x in parser.fit([])] == [0, 0, 0]
