import random
import shutil

import corpus_pipeline
import pytest
from cases import ODD, make_docs  # noqa: F401
from test_langid import SYLLABLES, speak
from test_simhash import brute_classes, brute_print
from test_toxicity import BAD
from test_winnowing import brute as brute_leaks

from taskloom.llm import toxicity
from taskloom.session import scratch_path


@pytest.fixture()
def folder(spark, make_docs, monkeypatch):  # noqa: F811
    """A folder with documents of every kind that a stage decides about."""
    monkeypatch.setattr(toxicity, "STEPS", 120)
    rng = random.Random(1)
    docs = []
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        words = speak(rng, lang, rng.randrange(40, 90)).split()
        if i % 6 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), lang))
    clean = [d for d in docs if d[0] % 6]
    item = speak(rng, "aa", 25)
    docs += [(300 + i, clean[i][1], clean[i][2]) for i in range(20)]  # exact copies
    docs += [(330 + i, clean[i + 30][1] + " " + item, "aa") for i in range(10)]  # leaks
    docs += [(None if d is None else 400 + d, t) for d, t in ODD if t is None or len(t) < 5000] + [(500, "123 456"), (1, clean[0][1], clean[0][2])]
    path = scratch_path(spark, "sf")
    make_docs(docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] % 6 == 0)) for d in docs if d[0] is not None and d[0] < 240], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    yield path, docs, item
    shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def by_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage_on_its_own_input(spark, folder):
    path, docs, item = folder
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    assert list(stages) == ["toxicity", "language", "near duplicates", "decontamination", "packing"]

    kept = stages["toxicity"](spark, frame, path)
    assert kept.columns == columns
    left = {d for d, _ in by_rows(kept) if d is not None and d < 240}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(left & toxic) <= 2 and len(set(range(240)) - toxic - left) <= 6

    kept = stages["language"](spark, frame, path)
    gone = set(map(str, [(d[0], d[1]) for d in docs])) - set(map(str, by_rows(kept)))
    assert kept.columns == columns
    assert gone == {str((d, t)) for d, t, *_ in docs if t is None or not any(c.isalpha() for c in t)}

    kept = stages["near duplicates"](spark, frame, path)
    classes = brute_classes([(d[0], brute_print(d[1])) for d in docs])
    of = {(d, f): c for d, f, c in classes}
    found = by_rows(kept)
    prints = [f"{brute_print(t):016x}" for _, t in found]
    root = {}
    for (_, f), c in of.items():
        root.setdefault(f, c)
    by_class = {}
    for d in docs:
        f = f"{brute_print(d[1]):016x}"
        by_class.setdefault((root[f], f if root[f] is None else None), []).append(d[0])
    assert len(found) == len(by_class)
    assert kept.columns == columns and len(prints) == len(found)
    assert not {d for d, _ in found} & set(range(300, 320)) and (1, docs[1][1]) in found and len([d for d, _ in found if d == 1]) == 1

    kept = stages["decontamination"](spark, frame, path)
    dirty = {r[0] for r in brute_leaks([(d[0], d[1]) for d in docs], [(1, item)]) if r[-1]}
    assert dirty == set(range(330, 340)) and kept.columns == columns
    assert by_rows(kept) == sorted(((d[0], d[1]) for d in docs if d[0] not in dirty), key=str)

    rows = stages["packing"](spark, frame, path).collect()
    assert sum(r.length for r in rows) == sum(len((d[1] or "").encode()) + 1 for d in docs)


def test_run_is_the_stages_in_turn(spark, folder):
    path, docs, item = folder
    rows = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & set(range(300, 340)) and len(ids & {i for i in range(240) if i % 6 == 0}) <= 2
    assert len(ids & {i for i in range(240) if i % 6}) >= 190


def test_run_on_empty_tables(spark, make_docs):  # noqa: F811
    path = scratch_path(spark, "sf")
    make_docs([]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
