"""Opponent pairing of game rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.schemas import BOX_COUNTS


def game_sizes(df: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def malformed_games(df: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """Games without exactly two rows, to be reported next to the paired table."""
    return game_sizes(df, keys).where(F.col("n_rows") != 2)


def pair_opponents(
    df: DataFrame, keys: Sequence[str] = ("game_id",), team: str = "team_id",
    counts: Sequence[str] = tuple(BOX_COUNTS), prefix: str = "opp_", against: DataFrame | None = None,
) -> DataFrame:
    """Every ordered pair of different teams in a game.

    A one-row game vanishes and a three-row game yields all its ordered pairs. `against` lets a
    subset on the left meet the full table on the right.
    """
    right = (df if against is None else against).select(
        *keys, F.col(team).alias(prefix + team), *[F.col(c).alias(prefix + c) for c in counts]
    )
    return df.join(right, list(keys)).where(F.col(team) != F.col(prefix + team))


def pair_two_sided(
    df: DataFrame, keys: Sequence[str] = ("game_id",), team: str = "team_id",
    counts: Sequence[str] = tuple(BOX_COUNTS), prefix: str = "opp_", carry: Sequence[str] = (),
) -> DataFrame:
    """Pairing where only well-formed games count: one aggregation instead of a self-join.

    The two sides of a game are its least and greatest row by team, kept by a combinable
    aggregate, so an oversized key collapses on the map side and is dropped by its count.
    """
    side = F.struct(F.col(team).alias("t"), *[F.col(c) for c in (*carry, *counts)])
    games = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(side).alias("_lo"), F.max(side).alias("_hi")
    ).where((F.col("_n") == 2) & (F.col("_lo.t") != F.col("_hi.t")))
    both = games.select(*keys, F.inline(F.array(
        F.struct(F.col("_lo").alias("me"), F.col("_hi").alias("them")),
        F.struct(F.col("_hi").alias("me"), F.col("_lo").alias("them")),
    )))
    return both.select(
        *keys, F.col("me.t").alias(team), *[F.col(f"me.{c}").alias(c) for c in (*carry, *counts)],
        F.col("them.t").alias(prefix + team),
        *[F.col(f"them.{c}").alias(prefix + c) for c in counts],
    )


def two_sides_of(schedule: DataFrame, shared: Sequence[str], per_side: Sequence[str]) -> DataFrame:
    """One row per game and side from a home_/away_ wide table."""
    def side(me: str, them: str):
        return F.struct(
            F.lit(me).alias("side"),
            *[F.col(f"{me}_{c}").alias(c) for c in per_side],
            *[F.col(f"{them}_{c}").alias(f"opp_{c}") for c in per_side],
        )
    return schedule.select(*shared, F.inline(F.array(side("home", "away"), side("away", "home"))))
