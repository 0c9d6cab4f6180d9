"""Exact interpolated quantiles of groups of any size.

A group is never gathered: its rows are range partitioned by value (`running_total`), which gives each row its place, and only the
two neighbours of each wanted place are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.operators.percentiles import running_total


def exact_quantiles(df: DataFrame, values: dict[str, tuple[str, float]], group: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One row per group; `values` maps an output column to (column, share). Linear between neighbours; NULL and NaN are left out.

    `ids` tell the rows of a group apart, so that equal values have one order.
    """
    out = None
    for column in dict.fromkeys(c for c, _ in values.values()):
        x = F.col(column).cast("double")
        rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*group, *[c for c in ids if c not in group], x.alias("_x"), F.lit(1.0).alias("_one"))
        placed = running_total(rows, list(group), ["_x", *[c for c in ids if c not in group]], "_one", "_place", "_n")
        found = []
        for name, (source, share) in values.items():
            if source != column:
                continue
            at = F.lit(float(share)) * (F.col("_n") - 1)
            low = F.floor(at)
            one = F.max(F.when(F.col("_place") == low + 1, F.col("_x")))
            two = F.max(F.when(F.col("_place") == low + 2, F.col("_x")))
            part = F.max(at - low)
            found.append(F.when(part > 0, one + part * (two - one)).otherwise(one).alias(name))
        one = placed.groupBy(*group).agg(*found)
        if out is None:
            out = one
        elif group:
            named = one.withColumnsRenamed({c: f"_r_{c}" for c in group})
            same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in group]
            out = out.join(named, same, "full").select(*[F.coalesce(c, f"_r_{c}").alias(c) for c in group], *[c for c in values if c in (*out.columns, *one.columns)])
        else:
            out = out.join(F.broadcast(one))
    return out
