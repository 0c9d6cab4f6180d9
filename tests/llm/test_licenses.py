"""Retrieved licenses against containment around every window."""

import random
import re

from hardwood.llm import licenses
from hardwood.llm.catalog import query_table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.split("[^a-z0-9]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def want(text):
    """template -> (containment, first window) over all windows that share a shingle with the template."""
    sh, out = shingles(text), {}
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        own = shingles(t.strip().rstrip("."))
        for s in range(0, len(sh), licenses.STRIDE):
            if set(own) & set(sh[s : s + licenses.INSIDE]):
                around = sh[max(0, s - len(own) + 1) : s + licenses.INSIDE + len(own)]
                share = len(set(own) & set(around)) / len(set(own))
                if share >= licenses.CONTAINMENT:
                    best, first = out.get(i, (0, s))
                    out[i] = (max(best, share), first)
    return out


def test_query_finds_every_license(spark, texts):
    got = {(r.doc_id, r.template): r for r in query_table()["op9_license_windows"](spark, SF).collect()}
    assert set(got) == {(d, t) for d, text in texts.items() for t in want(text)}
    assert all(got[d, t].containment == want(texts[d])[t][0] for d, t in got)


def test_planted_at_every_place(make):
    r = random.Random(5)
    rows = []
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        for at in range(12):
            filler = lambda n: " ".join("".join(r.choices("abcdeé", k=5)) for _ in range(n))
            rows.append((len(rows), f"{filler(at)}\n{text.upper() if at % 2 else text}\n{filler(r.randrange(30))}"))
    got = {(x.doc_id, x.template) for x in licenses.scan(make(rows)).collect()}
    planted = {(i, i // 12) for i in range(len(rows))}
    assert len(planted - got) <= 1 and got <= {(d, t) for d, text in rows for t in want(text)}


def test_changed_and_partial_texts(make):
    long = licenses.TEMPLATES[5][1]
    w = long.split()
    rows = [(1, long.replace("either", "any")), (2, " ".join(w[: len(w) // 2])), (3, " ".join(w[::-1])), (4, "the license of the software is free")]
    assert {(r.doc_id, r.template) for r in licenses.scan(make(rows)).collect()} == {(1, 5)}


def test_odd_tables(make):
    schema = "doc_id long, text string, template string, sh int, key int"
    assert licenses.scan(make([], schema)).count() == 0
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, None), (2, ""), (3, "a b"), (4, mit), (4, mit), (None, mit), (5, "x " * 60_000 + mit)]
    got = sorted(((r.doc_id or 0), r.license, r.containment) for r in licenses.scan(make(rows, schema)).collect())
    assert got == [(0, "MIT", 1.0), (4, "MIT", 1.0), (4, "MIT", 1.0), (5, "MIT", 1.0)]


def test_bounds_and_plan(make):
    assert licenses.collision() > 0.9998
    assert "Python" not in licenses.scan(make([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
