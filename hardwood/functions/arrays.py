"""Array and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.functions.metrics import _c


def lineup_set(players) -> Column:
    """Distinct, sorted, NULL-free lineup."""
    return F.array_sort(F.array_distinct(F.array_compact(_c(players))))


def lineup_slots(players, prefix: str = "player_id_", size: int = 5) -> list[Column]:
    """The first `size` members as flat NULL-padded columns."""
    return [F.get(_c(players), F.lit(k)).alias(f"{prefix}{k + 1}") for k in range(size)]


def rows_as_json(df: DataFrame, key: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """Report payload of each key: all its rows as one JSON text in the given order, and their number. A key is one team's report."""
    inner = [f for f in df.schema.fields if f.name not in key]
    first = [f for o in order for f in inner if f.name == o]
    cols = [
        F.bround(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in [*first, *[f for f in inner if f.name not in order]]
    ]
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    return df.groupBy(*key).agg(
        F.to_json(rows, {"ignoreNullFields": "false"}).alias("payload"), F.count(F.lit(1)).alias("n_rows")
    )

