"""Fill-in-the-middle texts against plain string work."""

import hashlib
import re

from hardwood.llm import middle
from hardwood.llm.catalog import oracle_texts, query_table
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def want(d, t, rate=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return d, len(units), "plain", None, None, t
    if h[3] % 100 < spm:
        return d, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return d, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["", None, "\n", "\n\n", "a", "a\n", "\na", "a\r\nb c\x85d\ne", "x<P>y", "<S>", "a<M", "M>b\n<\nP>", "<\n<P\nS>\n<S\n<M\n", "é日😀\n" * 40, "no mark\n" * 30_000, "\0\n\0", "l" * 300_000]


def rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(i + 100, "one\ntwo\nthree\nfour\n<\nP>") for i in range(60)] + [(None, "a\nb\nc"), (None, None), (3, "again\nand again"), (-5, "a\nb")]


def test_query_matches_sql(spark):
    same, note = compare(query_table()["op12_fill_in_middle"](spark, SF), duck(SF), oracle_texts()["op12_fill_in_middle"])
    assert same, note


def test_odd_texts(make):
    for rate, spm in ((100, 50), (60, 0), (60, 100)):
        docs = make(rows(), "doc_id long, text string, form string, n int, h1 string")
        made = middle.transform(docs, rate=rate, spm=spm)
        assert sorted((tuple(r) for r in made.collect()), key=str) == sorted((want(d, t, rate, spm) for d, t in rows()), key=str)
        back = sorted((tuple(r) for r in middle.restore(made).collect()), key=str)
        assert back == sorted(((d, t or "") for d, t in rows()), key=str)
    forms = {want(d, t)[2] for d, t in rows()}
    assert forms == {"plain", "psm", "spm"}


def test_digests(make):
    got = sorted((tuple(r) for r in middle.digest(make(rows())).collect()), key=str)
    assert got == sorted(((*want(d, t)[:5], sha(want(d, t)[5]), sha(t or "")) for d, t in rows()), key=str)
    assert middle.digest(make([])).count() == 0 and middle.transform(make([])).count() == 0
