"""Column contracts: rename, required columns, id types, canonical projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.schemas import BOX_COUNTS

ID_COLUMNS = ["team_id", "athlete_id", "game_id", "athlete_id_1", "athlete_id_2", "athlete_id_3"]

# Raw feed column of each canonical count.
RAW_BOX = {
    "pts": "team_score", "fga": "field_goals_attempted", "fgm": "field_goals_made",
    "fg3m": "three_point_field_goals_made", "fta": "free_throws_attempted", "oreb": "offensive_rebounds",
    "dreb": "defensive_rebounds", "tov": "total_turnovers",
}


def standardize(
    df: DataFrame, mapping: Mapping[str, str] | None = None, required: Sequence[str] = tuple(BOX_COUNTS),
    ids: Sequence[str] = ("game_id", "team_id"),
) -> DataFrame:
    """Lower-case names, apply source -> canonical renames, fail on what is still missing.

    A mapping entry whose source is absent is skipped; the contract check reports it if it matters.
    """
    out = df.toDF(*[c.lower() for c in df.columns])
    known = {src.lower(): dst for src, dst in (mapping or {}).items() if src.lower() in out.columns}
    out = out.withColumnsRenamed(known)
    missing = [c for c in (*ids, *required) if c not in out.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; present: {', '.join(out.columns)}")
    return out


def ids_as_text(df: DataFrame, columns: Sequence[str] = tuple(ID_COLUMNS)) -> DataFrame:
    """Ids to text; whole-number doubles lose their '.0' first, or joins would miss."""
    kinds = dict(df.dtypes)
    casts = {
        c: (F.col(c).cast("bigint") if kinds[c] in ("double", "float") else F.col(c)).cast("string")
        for c in columns if c in kinds
    }
    return df.withColumns(casts) if casts else df


def canonical_team_box(df: DataFrame, turnovers: str = "total_turnovers", keep: Sequence[str] = ("season", "season_type", "game_date")) -> DataFrame:
    """Raw team box to canonical counts; the turnover column is a choice of the feed."""
    cols = {**RAW_BOX, "tov": turnovers}
    lost = [v for v in cols.values() if v not in df.columns]
    if lost:
        raise ValueError(f"raw team box lacks {', '.join(lost)}")
    return df.select(
        F.col("game_id").cast("string").alias("game_id"), F.col("team_id").cast("string").alias("team_id"),
        *[F.col(c) for c in keep if c in df.columns],
        *[F.col(src).try_cast("double").alias(dst) for dst, src in cols.items()],
    )



def top_up(base: DataFrame, extra: DataFrame, keys: Sequence[str], date_col: str = "game_date") -> DataFrame:
    """Append rows newer than the base's last date: shared columns, base types, one row per key.

    The last date is one value, joined as a single-row table; bad casts become NULL.
    """
    shared = [f for f in base.schema.fields if f.name in extra.columns]
    last = base.agg(F.max(F.to_date(date_col)).alias("_last"))
    fresh = (
        extra.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.to_date(date_col) > F.col("_last")))
        .select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in shared])
        .dropDuplicates(list(keys))
    )
    return base.unionByName(fresh, allowMissingColumns=True)
