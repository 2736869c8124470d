import re

import pytest
from cases import ODD, make_docs  # noqa: F401

from taskloom.llm import licences


def words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams(text):
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def units(text):
    if text is None:
        return
    for i, line in enumerate(text.split("\n")):
        yield "line", i, line
    parts = re.split(r"\n[ \t\r]*\n\s*", text)
    if len(parts) > 1:
        for i, part in enumerate(parts):
            if "\n" in part:
                yield "paragraph", i, part
    if "\n" in text:
        yield "document", 0, text


def brute(text, templates, threshold):
    found, count = [], 0
    for kind, number, unit in units(text):
        if not unit.strip(" "):
            continue
        count += 1
        own = grams(unit)
        scored = []
        for name, template in templates.items():
            other = grams(template)
            if own and other:
                scored.append((-2 * len(own & other) / (len(own) + len(other)), name))
        if scored and -min(scored)[0] >= threshold:
            found.append((kind, number, min(scored)[1], round(-min(scored)[0], 9)))
    return count, sorted(found)


MIT = licences.TEMPLATES["mit-text"]
DOCS = [
    *[(d, t) for d, t in ODD if t is None or len(t) < 1000],
    (20, "prose\nReleased under the MIT License.\nmore prose"),
    (21, "RELEASED   under -- the `MIT` license"),
    (22, f"Some head\n\n{MIT[:200]}\n{MIT[200:]}\n\ntail of the text"),
    (23, MIT.replace("Software", "Program", 2)),
    (24, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0"),
    (25, "\n".join(MIT.split())),
    (26, "Released under the MIT License. " * 50),
    (27, "This work is licensed under the GNU General Public License, version 2."),
]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_against_every_template_without_pruning(make_docs, threshold):  # noqa: F811
    rows = licences.scan(make_docs(DOCS), threshold=threshold).collect()
    found = [(r.doc_id, r.n_units, sorted((m.unit, m.number, m.licence, round(m.dice, 9)) for m in r.matches)) for r in rows]
    assert sorted(found, key=str) == sorted(((d, *brute(t, licences.TEMPLATES, threshold)) for d, t in DOCS), key=str)


def test_size_bounds_are_not_too_tight(make_docs):  # noqa: F811
    """Eight bigrams against twelve, all shared: Dice is exactly 0.8."""
    templates = {"twelve": " ".join(f"w{i}" for i in range(13))}
    rows = licences.scan(make_docs([(1, " ".join(f"w{i}" for i in range(9))), (2, " ".join(f"w{i}" for i in range(8)))]), templates).collect()
    assert {r.doc_id: [m.licence for m in r.matches] for r in rows} == {1: ["twelve"], 2: []}


def test_ties_take_the_first_name_and_units_keep_their_text(make_docs):  # noqa: F811
    templates = {"b": "alpha beta gamma", "a": "alpha beta gamma!"}
    row = licences.scan(make_docs([(1, "Alpha, beta: gamma")]), templates).collect()[0]
    assert [(m.licence, m.text) for m in row.matches] == [("a", "Alpha, beta: gamma")]


def test_parameters_and_empty_table(make_docs):  # noqa: F811
    assert licences.scan(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        licences.scan(make_docs([]), threshold=0)
    with pytest.raises(ValueError):
        licences.scan(make_docs([]), {"one": "word"})


def test_plan_is_one_pass_without_python(make_docs):  # noqa: F811
    plan = licences.scan(make_docs(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Pandas", "Arrow", "Join"))
