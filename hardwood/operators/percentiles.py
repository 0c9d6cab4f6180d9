"""Percentiles and ranks inside groups that may each hold a large share of all rows.

A plain ordered window would sort one position group in one task. Here rows are range
partitioned by (group, value, tie break), so a large group or a heavily tied value is spread over
many partitions; per-block totals (one row per group and block) give every block its starting
point and the inside of a block is summed up where it was sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.functions.clock import round_half_even
from hardwood.functions.metrics import _c
from hardwood.operators.aggregates import weighted_mean
from hardwood.session import materialize


def _join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left key columns once."""
    renamed = right.select(*[
        F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns
    ])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


def _run_up(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str, running: str) -> Iterator[pa.RecordBatch]:
    """Running sums of each key's weights; the rows of a task come sorted by key."""
    last, carried = None, 0.0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changes = np.zeros(n, dtype=bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            changes[1:] |= codes[1:] != codes[:-1]
        sums = pc.fill_null(batch.column(weight), 0.0).to_numpy(zero_copy_only=False).copy()
        first = [batch.column(k)[0].as_py() for k in keys]
        starts = [0, *np.flatnonzero(changes).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            if a == 0 and first == last:
                sums[0] += carried
            np.cumsum(sums[a:b], out=sums[a:b])
        last, carried = [batch.column(k)[n - 1].as_py() for k in keys], float(sums[-1])
        yield batch.append_column(running, pa.array(sums))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: str,
    running: str = "running", total: str = "total", spare: Sequence[str] = (),
) -> DataFrame:
    """Running and full sum of `weight` per group in a total order, row by row. Columns in `spare` only serve the order."""
    cols = [F.col(c) for c in keys] + [_c(c) for c in order]
    sorted_blocks = (
        df.withColumn(weight, F.col(weight).cast("double"))
        .repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_block", F.spark_partition_id()).drop(*spare)
    )
    # Range bounds are sampled, so what a block has is written before it is read twice. A block is one task's, so the sums
    # inside it need no further exchange.
    schema = T.StructType([*sorted_blocks.schema.fields, T.StructField("_inside", T.DoubleType())])
    blocks = materialize(sorted_blocks.mapInArrow(partial(_run_up, keys=list(keys), weight=weight, running="_inside"), schema))
    sums = blocks.groupBy(*keys, "_block").agg(F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys, "_block",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)).alias("_before"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias(total),
    )
    # one row per group and one more per block
    return (
        _join_null_safe(blocks, F.broadcast(starts), [*keys, "_block"])
        .withColumn(running, F.col("_before") + F.col("_inside"))
        .drop("_block", "_before", "_inside")
    )


def _long(df: DataFrame, ids: Sequence[str], group: Sequence[str], specs: dict[str, tuple]) -> DataFrame:
    """One row per id and metric: metric, x, w."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("metric"), _c(x).cast("double").alias("x"), _c(w).cast("double").alias("w"))
        for k, (x, w) in specs.items()
    ])
    cols = list(dict.fromkeys([*ids, *group]))
    out = df.select(*cols, F.inline(rows))
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


#: Metrics whose rows are sorted in one exchange. All of them are worked on, one lot after the other.
LOT = 7


def weighted_percentiles(
    df: DataFrame, specs: dict[str, tuple], group: Sequence[str], ids: Sequence[str], tie: Sequence[Column],
    row: str | None = None,
) -> DataFrame:
    """Weighted cumulative share of every metric inside its group, as extra columns.

    `specs` maps the output column to (value, weight). A NULL value has no percentile, a NULL
    weight is zero, a group without positive weight has none, nor has a row with a NULL id. Ties are ordered by `tie`, made of
    `ids` and `group`. `row` names a column that numbers the stored rows of `df`: a number travels in place of the ids.
    """
    # a metric is a number while rows travel: every byte is shuffled once per metric
    numbered = list(enumerate(specs.values()))
    keys, ties = [row] if row else list(ids), {f"_tie{i}": t for i, t in enumerate(tie)}
    carried = df.withColumns(ties) if row else df
    order = ["x", *(ties if row else tie)]
    spare = ["x", *(ties if row else [])]
    scored = None
    for at in range(0, len(numbered), LOT):
        long = (
            _long(carried, [*keys, *ties] if row else keys, group, dict(numbered[at:at + LOT]))
            .where(F.col("x").isNotNull())
            .withColumn("w", F.coalesce("w", F.lit(0.0)))
        )
        # the rows of a lot are stored in order, so its exchange is gone before the next one's is written
        part = running_total(long, ["metric", *group], order, "w", spare=spare).select(
            *keys, "metric", F.when(F.col("total") > 0, F.col("running") / F.col("total")).alias("p")
        )
        scored = part if scored is None else scored.union(part)
    wide = scored.repartition(*keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == i, F.col("p"))).alias(name) for i, name in enumerate(specs)
    ])
    out = df.join(wide, keys, "left")
    if not row:
        return out
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids])
    return out.withColumns({name: F.when(known, F.col(name)) for name in specs})


def group_averages(df: DataFrame, specs: dict[str, tuple], group: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Weighted mean of each metric per group and the percentile that mean would take.

    The mean is scored as if appended as one more row carrying the mean weight, last among ties:
    (weight at or below it + mean weight) / (weight + mean weight).
    """
    long = _long(df, ids, group, specs)
    keys = ["metric", *group]
    means = long.groupBy(*keys).agg(
        weighted_mean("x", "w").alias("avg"),
        F.avg("w").alias("mean_w"),
        F.sum(F.when(F.col("x").isNotNull(), F.coalesce("w", F.lit(0.0)))).alias("sum_w"),
    )
    below = (
        _join_null_safe(long, F.broadcast(means.select(*keys, "avg")), keys)  # one row per group
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("x") <= F.col("avg"), F.coalesce("w", F.lit(0.0))).otherwise(0.0)).alias("below_w"))
    )
    return _join_null_safe(means, below, keys).select(
        *keys, F.col("avg"),
        F.when(
            F.col("avg").isNotNull() & (F.col("sum_w") + F.col("mean_w") > 0),
            (F.col("below_w") + F.col("mean_w")) / (F.col("sum_w") + F.col("mean_w")),
        ).alias("avg_percentile"),
    )


def value_ranks(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Least rank, average rank and group size for every distinct value (NULL values excluded)."""
    distinct = (
        df.where(F.col(x).isNotNull()).groupBy(*keys, x)
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    ranked = running_total(distinct, keys, [x], "_n", "_run", "group_n")
    return ranked.select(
        *keys, x,
        (F.col("_run") - F.col("_n") + 1).alias("min_rank"),
        (F.col("_run") - (F.col("_n") - 1) / 2).alias("avg_rank"),
        "group_n",
    )


def percent_ranks(
    df: DataFrame, metrics: Sequence[str], group: Sequence[str], ids: Sequence[str], lone: float | None = None,
) -> DataFrame:
    """Long (ids, metric, x, pct): (least rank - 1) / (n - 1); a lone value gets `lone` or zero."""
    long = _long(df, ids, group, {m: (m, F.lit(1.0)) for m in metrics}).drop("w")
    keys = ["metric", *group]
    ranks = value_ranks(long, keys, "x")
    single = F.lit(0.0 if lone is None else lone)
    return _join_null_safe(long, ranks, [*keys, "x"], "left").withColumn(
        "pct",
        F.when(F.col("x").isNull(), None).when(F.col("group_n") <= 1, single)
        .otherwise((F.col("min_rank") - 1) / (F.col("group_n") - 1)),
    ).select(*dict.fromkeys([*ids, *group]), "metric", "x", "pct")


def tercile_band(pct) -> Column:
    p = _c(pct)
    return F.when(p <= 1 / 3, 1).when(p <= 2 / 3, 2).when(p.isNotNull(), 3)


def average_rank_percentile(x, n, keys: Sequence[str], min_n: int) -> Column:
    """0..100 average-rank percentile among rows with enough sample, half-even rounded.

    For team tables: a population has a few hundred teams at most, so the group is small.
    """
    x, n = _c(x), _c(n)
    ok = x.isNotNull() & (n >= min_n)
    ok = F.coalesce(ok, F.lit(False))
    part = [F.col(k) for k in keys] + [ok]
    peers = F.count(F.lit(1)).over(Window.partitionBy(*part, x))
    rank = F.rank().over(Window.partitionBy(*part).orderBy(x))
    n_ok = F.count(F.lit(1)).over(Window.partitionBy(*part))
    avg_rank = rank + (peers - 1) / 2
    return F.when(ok & (n_ok >= 2), round_half_even(F.lit(100.0) * (avg_rank - 1) / (n_ok - 1)))
