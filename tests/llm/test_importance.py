"""Importance resampling against counts in a dictionary and a full sort."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.llm import importance
from hardwood.llm.catalog import query_table
from hardwood.llm.text import WordHashes, mix

SF = "/root/testdata/sf0.001"
LABEL = "doc_id long, quality int, toxic int"


def grams(text, hashes):
    words = re.findall(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+", (text or "").lower().encode())
    h = hashes.of(words)
    pairs = [mix(h[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + h[i + 1 : i + 2])[0] for i in range(len(h) - 1)]
    return [int(x) >> 46 for x in [*mix(h).tolist(), *map(int, pairs)]]


def brute(spark, rows, labels):
    """doc ids that stay, by sorting all keys."""
    hashes = WordHashes()
    made = [(d, grams(t, hashes)) for d, t in rows]
    good = {d: all(q == 1 and not x for e, q, x in labels if e == d) for d, q, x in labels}
    ids = [d for d, _ in rows]
    held = spark.createDataFrame([(d,) for d in {*ids, *good}], "doc_id long").select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)).alias("u"))
    place = {r.doc_id: r for r in held.collect()}
    fit = {d for d, g in good.items() if g and place[d].half == 0}
    raw, target = Counter(), Counter()
    for d, g in made:
        raw.update(g)
        if d in fit:
            target.update(g)
    share = sum(target.values()) / max(1, sum(raw.values()))
    if not share:
        return sorted(ids)
    weight = [sum(math.log((target[b] + 50 * share) / (share * (raw[b] + 50))) for b in g) / math.sqrt(max(1, len(g))) for _, g in made]
    key = [w * importance.SHARPNESS - math.log(-math.log((place[d].u + 0.5) / 2**52)) for (d, _), w in zip(made, weight, strict=True)]
    test = sorted(w for (d, _), w in zip(made, weight, strict=True) if good.get(d) and d not in fit)
    if not test:
        return sorted(ids)
    k = sum(w >= test[max(0, math.ceil(importance.LOSS * len(test)) - 1)] for w in weight)
    cut = sorted(key, reverse=True)[k - 1]
    return sorted(d for d, x in zip(ids, key, strict=True) if x >= cut)


def test_query_matches_brute_force(spark, texts):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = query_table()["op1_importance_quality"](spark, SF).collect()
    assert len(got) == len(texts)
    assert sorted(r.doc_id for r in got if r.kept) == brute(spark, list(texts.items()), labels)


def test_junk_goes_and_clean_text_stays(make, spark):
    rng = np.random.default_rng(1)
    clean = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "walks", "green", "over", "light"], 80))
    junk = lambda: " ".join(w + "%%%" for w in rng.choice(["buy", "now", "the", "cheap", "click"], 80))
    rows = [(i, junk() if i % 5 == 0 else clean()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 3)], LABEL)
    got = {r.doc_id: r.kept for r in importance.classify(make(rows), labels).collect()}
    assert not any(got[i] for i in range(0, 400, 5)) and sum(got[i] for i in range(400) if i % 5) >= 300  # the least of 53 held-out good ones sets k
    left = importance.keep_good(make([*rows, (None, "no id")]), labels)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(i for i in got if got[i])
    assert left.filter("doc_id IS NULL").count() == 1


def test_odd_tables(make, spark):
    none = spark.createDataFrame([], LABEL)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "w " * 50_000)]
    docs = make(rows, "doc_id long, text string, kept int, log_weight string, good int, gone int")
    assert importance.classify(docs, none).filter("kept").count() == 6
    assert importance.classify(make([]), none).count() == 0 and importance.keep_good(make([]), none).count() == 0
    odd = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 0), (9, 1, 0), (1, None, 0)], LABEL)
    assert importance.classify(docs, odd).count() == 6
    assert importance.classify(make([]), odd).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500, 1999, 2000, 5000])
def test_kth_largest(spark, k):
    values = np.round(np.random.default_rng(2).normal(size=2000) ** 3, 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    assert importance.kth_largest(df, "v", k) == np.sort(values)[::-1][min(k, 2000) - 1]
