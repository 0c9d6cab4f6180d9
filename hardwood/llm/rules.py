"""Quality rules with thresholds that come from the data: mergeable quantile sketches for each language and source.

A sketch is a count for each bin of a logarithmic grid (relative error BASE - 1 at most), so sketches merge by adding counts:
the partial ones of tasks into one cell, and the cells of a small source or language into the wider one. Addition doesn't
depend on the order, so a repeated or lost task changes no threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.llm.text import WordHashes, mix, slices, split_words, windows
from hardwood.session import materialize

#: Ratio of the bounds of a bin.
BASE = 1.02
#: A fence is this many interquartile ranges outside the quartiles, and a little more, as many clean texts have the value 0.
REACH = 6.0
METRICS = {"word_length": 1.0, "symbol_rate": 0.1, "dup_line_rate": 0.4, "repeat_rate": 0.3}
#: Documents that a sketch needs; a smaller cell takes the sketch of its language, a smaller language that of all.
LEAST = 200

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _repeated(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those of them in three-word windows that the text has twice or more."""
    words = [split_words(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = hashes.of([x for w in words for x in w])
    found, first = windows(flat, counts, 3)
    doc = np.repeat(np.arange(len(texts)), counts)
    keys = mix(found ^ mix(doc[first].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = first[order[twice]]
    marked = np.zeros(len(flat), bool)
    for j in range(3):
        marked[at + j] = True
    return counts, np.bincount(doc[marked], minlength=len(texts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for low, high, found in slices(batch.column(3)):
            texts = [t or "" for t in found]
            n_words, repeated = _repeated(texts, hashes)
            chars, symbols, copies, lines = [], [], [], []
            for t in texts:
                chars.append(len(t) - sum(map(t.count, _SPACES)))
                symbols.append(sum(map(t.count, _SYMBOLS)))
                worded = [x for x in t.split("\n") if x.strip(_SPACES)]
                lines.append(len(worded))
                copies.append(len(worded) - len(set(worded)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(low, high - low) for i in range(3)), *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols, copies, repeated, lines))],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts of every row, stored once: the only pass over the texts. Null text has no words."""
    held = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"),
    )
    return materialize(held.mapInArrow(_count, COUNTS))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _metrics(counted: DataFrame) -> DataFrame:
    """Adds the metrics, base_failed, and the cell (a null language or source is one of its own)."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    return counted.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_rate": share("n_symbols", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"), "repeat_rate": share("n_repeat_words", "n_words"),
        "base_failed": _failed(), "lang_key": known("lang"), "source_key": known("source"),
    })


def sketches(measured: DataFrame) -> DataFrame:
    """lang_key, source_key, metric, bin, n of the documents that pass the base rules. Zero is the bin null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")
    rows = measured.filter("NOT base_failed").select("lang_key", "source_key", pairs)
    bin_ = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / F.log(F.lit(BASE))).cast("int")).alias("bin")
    return rows.select("lang_key", "source_key", F.col("x.metric").alias("metric"), bin_).groupBy("lang_key", "source_key", "metric", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def fences(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, one column `low_<metric>` and `high_<metric>` per metric, n: from the sketches merged over all other keys."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "metric").orderBy(F.col("bin").asc_nulls_first())
    ranked = merged.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "metric")))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(BASE), F.col("bin")) / (1 + BASE))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))  # noqa: E731  values ascend with upto
    quart = ranked.groupBy(*keys, "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("n"))
    slack = F.create_map(*[F.lit(x) for m in METRICS.items() for x in m])[F.col("metric")]
    reach = REACH * (F.col("q3") - F.col("q1")) + slack
    quart = quart.select(*keys, "metric", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return quart.groupBy(*keys).agg(F.max("n").alias("n"), *[pick(m, c) for m in METRICS for c in ("low", "high")])


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per cell with documents: its fences, or those of its language or of all where a cell is small. Stored."""
    bins = materialize(sketches(measured))
    names = [f"{c}_{m}" for m in METRICS for c in ("low", "high")]
    cell, lang, every = fences(bins, ["lang_key", "source_key"]), fences(bins, ["lang_key"]), fences(bins.withColumn("one", F.lit(1)), ["one"])
    as_ = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}" if c in (*names, "n") else c) for c in df.columns])
    cells = measured.select("lang_key", "source_key").distinct().withColumn("one", F.lit(1))
    held = cells.join(as_(cell, "c"), ["lang_key", "source_key"], "left").join(as_(lang, "l"), "lang_key", "left").join(as_(every, "a"), "one", "left")
    best = lambda c: F.when(F.col("c_n") >= LEAST, F.col(f"c_{c}")).when(F.col("l_n") >= LEAST, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return materialize(held.select("lang_key", "source_key", *map(best, names)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    A text fails the base rules with under 50 words (null and empty texts too) or with more than half of its words in
    repeated windows. Of the others, one fails whose metric is outside the fences of its cell; failed_rule names the first.
    Repeated rows count each time; null languages or sources are cells of their own; no rows give no rows.
    """
    measured = _metrics(counts(docs, doc_id, text, lang, source))
    limits = thresholds(measured)
    held = measured.join(limits, ["lang_key", "source_key"], "left")
    outside = lambda m: (F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}"))
    rule = F.when(F.col("base_failed"), "base")
    for m in METRICS:
        rule = rule.when(outside(m), m)
    return held.withColumn("failed_rule", rule).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule"
    )
