"""Quality rules against plain counting, and the sketches' fences."""

import re

import numpy as np
import pytest

from hardwood.llm import rules
from hardwood.llm.catalog import oracle_texts, query_table
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def want(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, marked = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked |= {i + j for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


TEXTS = [None, "", " \n\t", "a b c a b c a", "x\n\nx\nx \n y|<>#", "é ü word " * 40, "same three words " * 40, "w" * 90_000, "a b c d e f " * 20_000,
         "\n".join(f"line {i} of many words here" for i in range(30)), "\x1cx\x0by\x0cz " + "abc def ghi jkl mno " * 3]


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)


def test_counts(make, texts):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s") for i, t in enumerate(TEXTS)] + [(1, "", "en", None), (None, TEXTS[9], None, None)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_words string, metric int, bin int")
    assert rows_of(rules.judge(docs)) == sorted(((r[0], *want(r[1])) for r in rows), key=str)
    assert rules.judge(make([])).count() == 0


def test_query_matches_counts(spark, texts):
    assert rows_of(query_table()["op10_adaptive_rules"](spark, SF)) == sorted(((d, *want(t)) for d, t in texts.items()), key=str)


def test_query_matches_sql(spark):
    same, note = compare(query_table()["op10_adaptive_rules"](spark, SF), duck(SF), oracle_texts()["op10_adaptive_rules"])
    assert same, note


@pytest.mark.parametrize("docs", [30, 400])
def test_fences_adapt_to_the_cell(make, docs):
    """Symbols are usual in one source and not in the other; a small cell takes the wider sketch."""
    rng = np.random.default_rng(docs)
    rows = []
    for i in range(docs * 2):
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) + ("##" if i % 2 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "code" if i % 2 else "prose"))
    rows.append((9999, " ".join("abcdef" + "ghijk"[i % 5] * (1 + i) + "##" for i in range(60)), "en", "prose"))
    kept = {r.doc_id: r for r in rules.judge(make(rows)).collect()}
    assert all(kept[i].kept for i in range(docs * 2))
    assert kept[9999].kept == False  # noqa: E712
    if docs >= rules.LEAST:
        assert kept[9999].failed_rule in ("word_length", "symbol_rate")


def test_quartiles_are_within_the_relative_error(make):
    rng = np.random.default_rng(3)
    words = rng.integers(2, 30, 400)
    docs = make([(i, " ".join("abcdefghijklmnopqrstuvwxyzabcdef"[:n] + str(j) for j in range(60)), "en", "s") for i, n in enumerate(words.tolist())])
    measured = rules._metrics(rules.counts(docs))
    got = rules.fences(rules.sketches(measured), ["lang_key"]).collect()[0]
    values = np.sort([r.word_length for r in measured.collect()])
    q1, q3 = values[99], values[299]
    span = rules.REACH * (q3 - q1) + rules.METRICS["word_length"]
    assert got.n == 400 and abs(got.high_word_length - (q3 + span)) < 0.02 * (7 * q3 + 6 * q1) and abs(got.low_word_length - (q1 - span)) < 0.02 * (7 * q1 + 6 * q3)
