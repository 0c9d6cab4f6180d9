"""Wide to long, long to wide and stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name="metric", value="value") -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), name, value
    )


def radar_rows(
    df: DataFrame, ids: Sequence[str], slices: dict[str, tuple[str, str | None]], inverted: Sequence[str],
) -> DataFrame:
    """Radar chart rows: player and group-average percentile per slice.

    `slices` maps a label to (player percentile column, average percentile column). Inverted
    slices read 1 - p; a missing player value is zero, a missing average stays missing.
    """
    def flip(label: str, c: Column) -> Column:
        return F.lit(1.0) - c if label in inverted else c

    rows = F.array(*[
        F.struct(
            F.lit(i).alias("slice_order"), F.lit(label).alias("label"),
            F.coalesce(flip(label, F.col(p)), F.lit(0.0)).alias("player_pct"),
            (flip(label, F.col(a)) if a else F.lit(None).cast("double")).alias("average_pct"),
        )
        for i, (label, (p, a)) in enumerate(slices.items(), 1)
    ])
    return df.select(*ids, F.inline(rows))


def to_wide(df: DataFrame, keys: Sequence[str], name: str, names: Sequence, value: str) -> DataFrame:
    """Long to wide over a stated list of names, so no extra job is needed to find them."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct by key keeping the first row in a stated order, as one combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
