"""Game lists: which games to process and which are already done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_games(schedule: DataFrame, team: str | None = None, start=None, end=None) -> DataFrame:
    """Completed games in date order, optionally of one team (either side) and date range."""
    s = schedule.where(F.col("status_type_completed"))
    if team is not None:
        t = team.lower()
        s = s.where((F.lower("home_abbreviation") == t) | (F.lower("away_abbreviation") == t))
    if start is not None:
        s = s.where(F.to_date("game_date") >= F.lit(start).cast("date"))
    if end is not None:
        s = s.where(F.to_date("game_date") <= F.lit(end).cast("date"))
    return s.groupBy("game_id").agg(F.min("game_date").alias("game_date")).orderBy("game_date", "game_id")


def pending_games(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested games without rows in the stored table."""
    return requested.join(done.select("game_id").distinct(), "game_id", "left_anti")


def cache_status(requested: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Requested, stored and missing game counts per stored table."""
    want = requested.select("game_id").distinct()
    out = None
    for name, df in tables.items():
        have = df.select("game_id").distinct().withColumn("_have", F.lit(True))
        row = want.join(have, "game_id", "left").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("requested"), F.count("_have").alias("stored"),
            F.count(F.when(F.col("_have").isNull(), 1)).alias("missing"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def stored_profiles(profiles: DataFrame, league: str | None = None) -> DataFrame:
    p = profiles if league is None else profiles.where(F.col("league") == league)
    return p.select("league", "population", "season").distinct().orderBy("league", "population", "season")


def read_profile(profiles: DataFrame, league: str, season: int, population: str) -> DataFrame:
    """One stored profile; absent is an error, a query never builds one."""
    p = profiles.where((F.col("league") == league) & (F.col("season") == season) & (F.col("population") == population))
    if p.limit(1).count() == 0:
        raise LookupError(f"no stored profile for {league} {season} {population!r}")
    return p
