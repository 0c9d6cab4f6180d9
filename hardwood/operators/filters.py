"""Row filters and projections shared by the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.functions.metrics import _c
from hardwood.schemas import SEASON_TYPES


def clean_player_box(df: DataFrame, honour_dnp: bool = True) -> DataFrame:
    """Rows that played. With `honour_dnp=False` only positive minutes count."""
    played = F.col("minutes") > 0
    if honour_dnp:
        played = played & ~F.coalesce(F.col("did_not_play"), F.lit(False))
    return df.where(played)


def valid_team_games(df: DataFrame, score="pts", fga="fga", season_type: int = 2) -> DataFrame:
    return df.where(
        (F.col("season_type") == season_type) & F.col(score).isNotNull() & (F.col(fga) > 0)
    )


def season_type_filter(df: DataFrame, name: str = "regular") -> DataFrame:
    if name == "all":
        return df
    if name not in SEASON_TYPES:
        raise ValueError(f"season type {name!r} is not one of {sorted(SEASON_TYPES)} or 'all'")
    return df.where(F.col("season_type") == SEASON_TYPES[name])


def drop_nonstandard(
    df: DataFrame, schedule: DataFrame, patterns: Sequence[str], max_team_id: int = 100000
) -> DataFrame:
    """Drop exhibition teams, then games whose headline starts with one of the patterns."""
    odd = schedule.where(F.col("notes_headline").rlike("|".join(f"^(?:{p})" for p in patterns)))
    return df.where(F.col("team_id").cast("bigint") < max_team_id).join(
        odd.select("game_id"), "game_id", "left_anti"
    )


def keep_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(members.select(*([on] if isinstance(on, str) else on)), on, "left_semi")



def population_games(
    events: DataFrame, population: DataFrame, home="home_team_abbrev", away="away_team_abbrev",
) -> DataFrame:
    """Rows whose home or away team is in the population (a one-column `team` table).

    Grouped pandas code and windows downstream stop predicate pushdown, so this runs first.
    """
    teams = population.select("team").distinct()
    home_hit = teams.select(F.col("team").alias(home), F.lit(True).alias("_home_in"))
    away_hit = teams.select(F.col("team").alias(away), F.lit(True).alias("_away_in"))
    return (
        events.join(home_hit, home, "left").join(away_hit, away, "left")
        .where(F.coalesce("_home_in", F.lit(False)) | F.coalesce("_away_in", F.lit(False)))
        .drop("_home_in", "_away_in")
        .select(*events.columns)
    )


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with the first failing rule's name). A rule is true for a good row."""
    reason = F.lit(None).cast("string")
    for name, good in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    return (
        tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        tagged.where(F.col("reject_reason").isNotNull()),
    )


def as_of(df: DataFrame, cutoff, date_col: str = "game_date") -> DataFrame:
    return df.where(F.to_date(F.col(date_col)) <= F.lit(cutoff).cast("date"))


def minimum_sample(df: DataFrame, **bounds: float) -> DataFrame:
    for c, lo in bounds.items():
        df = df.where(F.col(c) >= lo)
    return df


def find_team(names: DataFrame, text: str, column: str = "team_name") -> DataFrame:
    """Exact matches if there are any, else literal substring matches (both ignore case)."""
    low = F.lower(F.col(column))
    wanted = text.lower()
    scored = names.where(low.contains(wanted)).withColumn("_exact", low == wanted)
    any_exact = scored.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_any"))
    return (
        scored.join(F.broadcast(any_exact)).where(F.col("_exact") | ~F.col("_any"))
        .drop("_exact", "_any")
    )


def resolve_one_team(names: DataFrame, text: str, column: str = "team_name") -> str:
    """The single match of `find_team`; none or several is an error with their number and the first and last in order."""
    hits = find_team(names, text, column).agg(F.countDistinct(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if hits.n != 1:
        raise ValueError(f"{text!r} matches {hits.n} teams" + (f", {hits.low!r} to {hits.high!r}; `find_team` lists them" if hits.n else ""))
    return hits.low


def suggest_names(names: DataFrame, text: str, column: str, share: float = 0.3, k: int = 5) -> DataFrame:
    """Closest spellings within an edit distance of `share` of the wanted length."""
    limit = max(1, int(share * len(text) + 0.999))
    d = F.levenshtein(F.lower(F.col(column)), F.lit(text.lower()))
    return (
        names.select(column).distinct().withColumn("distance", d).where(F.col("distance") <= limit)
        .orderBy("distance", column).limit(k)
    )


def round_numeric(df: DataFrame, digits: int, skip: Sequence[str] = ()) -> DataFrame:
    """Half-even rounding of every floating column."""
    return df.select(*[
        F.bround(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
        else F.col(f.name)
        for f in df.schema.fields
    ])



def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Report trim: keep and rename the mapped columns that exist, in mapping order."""
    return df.select(*[_c(src).alias(dst) for dst, src in mapping.items() if src in df.columns])
