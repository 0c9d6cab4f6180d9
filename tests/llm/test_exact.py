"""Exact duplicates against a dictionary of texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hardwood.llm import exact
from hardwood.llm.catalog import oracle_texts, query_table
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, "a b "), (1, None), (8, ""), (2, " "), (7, "x" * 50_000), (6, "x" * 50_000), (None, "a b"),
        (11, None), (11, None), (12, "only"), (None, "alone"), (13, "a b")]


def want(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for d in sorted(ids, key=lambda d: (d is None, d)):
            out.append((d, keep, len(ids), first, sha))
            first = False
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS, [(i % 50, f"t {i % 7}") for i in range(400)]])
def test_labels(make, rows):
    got = exact.label_copies(make(rows, "doc_id long, text string, kept string, sha string, row_no int"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want(rows)


def test_kept_rows_keep_their_columns(make):
    docs = make([(d, t, "en", f"s{i}", i) for i, (d, t) in enumerate(ROWS)])
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((w[0] for w in want(ROWS) if w[3]), key=str)


def test_table_misses_no_repeat(spark, make):
    keys = spark.range(3000).select((F.col("id") % 2000).cast("string").alias("sha"))
    bits = exact.table_bits(3000)
    marked = keys.withColumn("again", exact.in_table(exact.slot_table(keys, "sha", bits), F.col("sha"), bits))
    assert marked.filter("sha < 0 or cast(sha as int) < 1000").filter("NOT again").count() == 0
    assert marked.filter("cast(sha as int) >= 1000").filter("again").count() < 100
    assert exact.table_bits(1 << 40) == exact.MOST_BITS and exact.table_bits(0) == exact.PIECE


def test_query_matches_sql(spark):
    same, note = compare(query_table()["op4_exact_dedup"](spark, SF), duck(SF), oracle_texts()["op4_exact_dedup"])
    assert same, note
