"""Spelling variants against every pair of words."""

import re
import zlib
from collections import Counter

import numpy as np

from hardwood.llm import variants
from hardwood.llm.catalog import oracle_texts, query_table
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(rows):
    n = words(rows)
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_query_matches_sql(spark):
    same, note = compare(query_table()["op11_spelling_variants"](spark, SF), duck(SF), oracle_texts()["op11_spelling_variants"])
    assert same, note


def test_odd_texts(make, monkeypatch):
    base = ["abandon", "abandons", "abandonss", "banquet", "banquetté", "Éclairs", "éclairs", "ÉCLAIRS", "streets", "street", "atreets", "ztreets", "mississippi", "misissippi"]
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(zip(base, [30, 400, 5000, 5, 4, 3, 2, 2, 40, 9, 400, 400, 50, 4], strict=True))]
    rows += [(90, None), (91, ""), (None, "abandon,abandon;mississippi"), (None, "abandon"), (92, "word " * 50), (93, ("q" * 70_000 + " ") * 2), (94, ("q" * 69_999 + " ") * 30), (93, "streets streets")]
    docs = make(rows, "doc_id long, text string, word string, n long, key int")
    got = sorted((tuple(r) for r in variants.group_variants(docs).collect()), key=str)
    assert got == want(rows)
    assert any(r[1] and r[2] != r[1] for r in got) and any(r[4] > 1 for r in got)  # a chain, and ties
    assert variants.group_variants(make([])).count() == 0


def test_trie_finds_every_near_pair():
    rng = np.random.default_rng(3)
    made = sorted({bytes(rng.integers(97, 101, rng.integers(7, 10), dtype=np.uint8)) for _ in range(1500)})
    trie = variants.Trie(made, np.arange(len(made)))
    mine, found = variants.Words(made), set()
    change, up, down = variants.moves()
    top = variants.vectors(made)[:, : variants.LEVELS]
    full = variants.vectors(trie.words.words)[:, : variants.LEVELS]
    for m, (move, s, d) in enumerate(zip(change, up, down, strict=True)):
        for i, j in trie.search(variants.vectors(made)[:, variants.LEVELS :], np.full(len(made), s), np.full(len(made), d)):
            here = (full[j] == top[i] + move).all(1)
            ok = variants.near(mine, i[here], trie.words, j[here])
            found |= {(made[a], trie.words.words[b]) for a, b in zip(i[here][ok].tolist(), j[here][ok].tolist(), strict=True)}
    assert found == {(a, b) for a in made for b in made if edits(a.decode(), b.decode())} and len(found) > 200
