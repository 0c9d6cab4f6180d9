"""Quality classifier by importance resampling: hashed n-gram models of the target and of the raw text.

A document's weight is the ratio of two generative models over hashed words and word pairs, p_target / p_raw, as a
log-likelihood ratio over the root of its number of n-grams, so that long and short texts have one scale. Gumbel noise on
the scaled log weights and the k largest keys draw a sample without replacement in proportion to the weights.

k is not a constant: it is the number of documents whose weight reaches what all but LOSS of the held-out good
documents reach. The raw model counts every document; the target model counts the labelled good ones of a sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.exact import without_ids
from hardwood.llm.text import WordHashes, mix, slices
from hardwood.session import materialize

#: Buckets of hashed n-grams (a fixed-size model); pseudo-counts that draw a rare bucket's ratio to one.
BUCKETS, PRIOR = 1 << 18, 50.0
#: Most labelled documents of each kind that the classifier is fitted on; half of the good ones make the target model, the others set k.
SAMPLE = 100_000
#: Share of the held-out good documents that k may cost, and log weights per unit of Gumbel noise.
LOSS, SHARPNESS = 0.001, 200.0

_TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")


def _buckets(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words (runs of letters, digits, or of symbols; lower case) and neighbouring pairs, and the document of each."""
    words = [_TOKEN.findall((t or "").lower().encode("utf-8", "surrogatepass")) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = hashes.of([x for w in words for x in w])
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = doc[1:] == doc[:-1]
    pairs = mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])[inside]
    every = np.concatenate([mix(flat), pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return every.astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def _counter(target: np.ndarray):
    """Counts of each bucket over a task's documents, and over those that are in `target` (sorted ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, chosen = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            good = np.isin(ids, target) & np.asarray(batch.column(0).is_valid())
            for low, high, texts in slices(batch.column(1)):
                at, doc = _buckets(texts, hashes)
                total += np.bincount(at, minlength=BUCKETS)
                chosen += np.bincount(at[good[low:high][doc]], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        for low in range(0, len(seen), 50_000):
            part = seen[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part]), pa.array(chosen[part])], names=["bucket", "n", "t"])

    return run


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low, high, texts in slices(batch.column(1)):
                at, doc = _buckets(texts, hashes)
                n = np.bincount(doc, minlength=len(texts))
                total = np.bincount(doc, weights=ratio[at], minlength=len(texts))
                weight = total / np.sqrt(np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(weight)], names=["doc_id", "n_grams", "log_weight"])

    return run


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, good, fit of at most `sample` good and as many other labelled documents (smallest hashes); stored.

    Good: quality 1 and not toxic. A document with several labels is good if all are. `fit` marks the half of the good
    ones that the target model counts. Null ids or labels aren't used.
    """
    held = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    held = held.withColumn("h", F.xxhash64("doc_id"))
    parts = [held.filter(c).orderBy("h", "doc_id").limit(sample) for c in ("good", "NOT good")]
    return materialize(parts[0].unionByName(parts[1]).select("doc_id", "good", (F.col("good") & (F.pmod("h", F.lit(2)) == 0)).alias("fit")))


def bucket_ratios(spark: SparkSession, rows: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of every bucket; the model has BUCKETS numbers whatever the corpus."""
    counts = rows.mapInArrow(_counter(target_ids), "bucket int, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    held = counts.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[held["bucket"]], target[held["bucket"]] = held["n"], held["t"]
    share = target.sum() / max(raw.sum(), 1.0)
    if share == 0:
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR * share) / (share * (raw + PRIOR)))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a stored double column, by counts of ever finer ranges; each step reads 1,024 counts."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    above = 0
    while low < high:
        step = (high - low) / 1024
        if step == 0 or low + step == low:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)).cast("int"), F.lit(1023))
        found = keys.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for r in sorted(found.collect(), key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
    return high


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_grams, log_weight, gumbel_key, kept.

    kept marks the documents of the Gumbel top-k (all that tie with the k-th key). A text without words (null too) has
    weight 0. The noise comes from a hash of doc_id, so repeated rows and repeated runs get the same key; rows without a
    doc_id share one. Without a good label every document weighs 0 and stays. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labelled_sample(labels, sample)
    target = np.sort(np.array([r.doc_id for r in known.filter("fit").select("doc_id").toLocalIterator()], np.int64))
    ratio = bucket_ratios(spark, rows, target)
    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.col("doc_id"), F.lit("gumbel")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    scored = rows.mapInArrow(_scorer(ratio), "doc_id long, n_grams long, log_weight double")
    scored = materialize(scored.withColumn("gumbel_key", F.col("log_weight") * SHARPNESS + noise))
    held_out = scored.join(known.filter("good AND NOT fit").select("doc_id"), "doc_id", "left_semi")
    least = held_out.agg(F.percentile_approx("log_weight", F.lit(LOSS), F.lit(100_000))).first()[0]
    if least is None:
        return scored.withColumn("kept", F.lit(True))
    k = scored.filter(F.col("log_weight") >= least).count()
    cut = kth_largest(scored, "gumbel_key", k)
    return scored.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(cut), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that the classifier rejects, all columns as they were; a row without a doc_id stays."""
    rejected = classify(docs, labels, doc_id, text).filter("NOT kept").select("doc_id")
    return without_ids(docs, materialize(rejected), doc_id)
