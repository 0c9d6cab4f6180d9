"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from hardwood.llm import oddsketch
from hardwood.llm.catalog import query_table
from hardwood.llm.text import WordHashes

SF = "/root/testdata/sf0.001"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent):
    """doc_id -> (n_shingles, component)."""
    held = [(d, sets(t)) for d, t in rows]
    up = {d: d for d, _ in held if d is not None}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if a is not None and b is not None and x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a0, b0 = top(a), top(b)
                    up[max(a0, b0)] = min(a0, b0)
    return sorted(((d, len(x), top(d) if d is not None else None) for d, x in held), key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_query_matches_all_pairs(spark, texts):
    assert got(query_table()["op6_odd_sketch_dedup"](spark, SF)) == brute(texts.items(), 85)


def planted(seed, groups, size):
    """Groups of copies with 0 to 25 % of the words changed, so that many pairs stand near the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, shared = [], [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 5, 9, 40, 150, 400]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.2:
                w += shared
            rows.append((len(rows) * 7 + 3, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_planted_groups(make, percent, seed, monkeypatch):
    monkeypatch.setattr(oddsketch, "BLOCK", 8)
    monkeypatch.setattr(oddsketch, "BLOCK_SHINGLES", 900)
    rows = planted(seed, 25, 12)
    assert got(oddsketch.near_duplicates(make(rows), percent)) == brute(rows, percent)


def test_odd_tables(make):
    schema = "doc_id long, text string, rep string, key string, comp int, a int"
    assert oddsketch.near_duplicates(make([], schema)).count() == 0
    rows = [(4, None), (2, None), (9, " \t\n"), (7, ""), (5, "One two"), (3, "one TWO"), (8, "one two three four five"), (6, "É one"),
            (1, "é one"), (None, "one two"), (11, "w " * 60_000), (12, "W\n" * 50_000), (3, "one TWO")]
    assert got(oddsketch.near_duplicates(make(rows, schema))) == brute(rows, 80)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_texts_that_share_a_doc_id(make, seed):
    """Each text of a repeated doc_id has its links, in whatever order the rows come."""
    r = random.Random(seed)
    one, two, three = ([r.choice("abcdefgh") + str(i) for i in range(60)] for _ in range(3))
    text = lambda w, k: " ".join([*w[:-k], *(f"z{k}{i}" for i in range(k))])
    rows = [(5, text(one, 1)), (5, text(two, 1)), (5, text(two, 1).upper()), (7, text(one, 2)), (8, text(two, 2)), (9, text(three, 1)), (2, text(three, 2)), (12, text(three, 3)), (12, "x y")]
    r.shuffle(rows)
    want = brute(rows, 80)
    assert got(oddsketch.near_duplicates(make(rows))) == want
    assert {c for d, _, c in want if d in (5, 7, 8)} == {5} and {c for d, _, c in want if d in (2, 9, 12)} == {2}


def test_sketch_estimates_and_bounds():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    near = np.unique(np.concatenate([base[150:], rng.integers(0, 1 << 63, 150).astype(np.uint64)]))
    sketch, bands = oddsketch.signatures_of([np.unique(base), near, np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))])
    apart = lambda i, j: int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
    assert apart(0, 1) <= oddsketch.most_apart(85) < apart(0, 2)
    assert (bands[0] == bands[1]).sum() > 5 and not (bands[0] == bands[2]).any()
    assert oddsketch.missed(0.85) < 1e-8 and oddsketch.missed(0.8) < 4e-6


def test_short_sets_keep_word_order_and_length():
    a, b, c, d = oddsketch.shingle_sets(["a b", "b a", "A  b", ""], WordHashes())
    assert a.tolist() == c.tolist() != b.tolist() and not len(d)
