"""Team play profiles: category counts, frequencies, points per unit and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.geometry import shot_zone
from hardwood.operators import events as E
from hardwood.operators.filters import population_games
from hardwood.operators.percentiles import average_rank_percentile
from hardwood.plans.possessions import possession_rows, possession_state, prepared_events
from hardwood.schemas import FREQ_BAD_CATEGORIES, FREQ_RANKED_DIMENSIONS, MIN_POSS_FOR_PERCENTILE

#: Team abbreviations are shared by leagues, and a profile is one season.
SCOPE = ["league", "season"]
KEYS = [*SCOPE, "off_team", "def_team", "dimension", "category", "unit"]


def possession_categories(poss: DataFrame) -> DataFrame:
    """Context and ball-security rows; a turnover is live when the next start is a steal."""
    c = F.col
    w = Window.partitionBy("game_id").orderBy("poss_id")
    security = (
        F.when(c("end_reason") != "turnover", "no_turnover")
        .when(c("_next") == "steal", "live_ball_to").otherwise("dead_ball_to")
    )
    cat = lambda dim, value: F.struct(F.lit(dim).alias("dimension"), value.alias("category"), F.lit("possession").alias("unit"))
    return poss.withColumn("_next", F.lead("start_reason").over(w)).select(
        *SCOPE, "game_id", "off_team", "def_team", "points",
        F.inline(F.array(cat("context", c("context")), cat("ball_security", security))),
    )


def shot_categories(events: DataFrame) -> DataFrame:
    """Shot-zone rows for attempts with a location, creation rows for makes."""
    c = F.col
    side = (c("team_id") == c("home_team_id")) | (c("team_id") == c("away_team_id"))
    points = F.when(c("made"), F.when(c("is_three"), 3).otherwise(2)).otherwise(0)
    cat = lambda dim, value, unit: F.struct(F.lit(dim).alias("dimension"), value.alias("category"), F.lit(unit).alias("unit"))
    zone = shot_zone("coordinate_x", "coordinate_y", "is_three")
    return events.where(c("profile_shot") & side).select(
        *SCOPE, "game_id", E.side_abbrev(c("team_id")).alias("off_team"), E.side_abbrev(E.other_team()).alias("def_team"),
        points.alias("points"),
        F.inline(F.array(
            cat("shot_zone", zone, "attempt"),
            cat("creation", F.when(c("made"), F.when(c("assisted"), "assisted").otherwise("unassisted")), "made_fg"),
        )),
    ).where(c("category").isNotNull())


def category_rows(pbp: DataFrame, per_game: bool = False) -> DataFrame:
    """Counts and points per league, season, offence, defence, dimension and category; for each game on request."""
    ev = prepared_events(pbp)
    rows = possession_categories(possession_state(possession_rows(ev))).unionByName(shot_categories(ev))
    keys = ["game_id", *KEYS] if per_game else KEYS
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


def profile_from_categories(rows: DataFrame, population: DataFrame | None = None, min_n: int = MIN_POSS_FOR_PERCENTILE) -> DataFrame:
    """Offence and defence side by side with percentiles among the population's teams of the same league and season.

    Ranking windows hold one row per team of a league season, a few hundred at most.
    """
    c = F.col
    scope = [k for k in SCOPE if k in rows.columns]
    ids = [*scope, "team", "dimension", "category", "unit"]

    def side(team: str, n: str, pts: str) -> DataFrame:
        s = rows.withColumnRenamed(team, "team")
        if population is not None:
            s = s.join(population.select("team").distinct(), "team", "left_semi")
        return s.groupBy(*ids).agg(F.sum("n").alias(n), F.sum("points").alias(pts))

    off = side("off_team", "off_n", "_op").withColumn(
        "off_freq", c("off_n") / F.sum("off_n").over(Window.partitionBy(*scope, "team", "dimension"))
    ).withColumn("off_ppp", c("_op") / c("off_n")).drop("_op")
    dfn = side("def_team", "def_n", "_dp").withColumn("def_ppp", c("_dp") / c("def_n")).drop("_dp")
    prof = off.join(dfn, ids, "full")

    by = [*scope, "dimension", "category"]
    by_freq = c("dimension").isin(FREQ_RANKED_DIMENSIONS)
    sign = F.when(c("category").isin(FREQ_BAD_CATEGORIES), -1.0).otherwise(1.0)
    group_total = F.sum("def_n").over(Window.partitionBy(*by))
    prof = prof.withColumn("_def_freq", F.when(group_total > 0, c("def_n") / group_total))
    prof = prof.withColumns({
        "_ok": F.when(by_freq, sign * c("off_freq")).otherwise(c("off_ppp")),
        "_dk": F.when(by_freq, sign * c("_def_freq")).otherwise(c("def_ppp")),
    })
    return prof.withColumns({
        "off_ppp_pctl": average_rank_percentile("_ok", "off_n", by, min_n),
        "def_ppp_pctl": average_rank_percentile("_dk", "def_n", by, min_n),
    }).drop("_ok", "_dk", "_def_freq")


def play_profile(
    pbp: DataFrame, population_name: str = "national", population: DataFrame | None = None,
    min_n: int = MIN_POSS_FOR_PERCENTILE, source: str = "pbp_derived",
) -> DataFrame:
    """Stored-profile table of every league season in the events, for one population."""
    games = pbp if population is None else population_games(pbp, population)
    prof = profile_from_categories(category_rows(games), population, min_n)
    return prof.select(
        "league", F.col("season").cast("int").alias("season"), F.lit(population_name).alias("population"),
        "team", "dimension", "category", "unit", F.lit(source).alias("source"), "off_n", "off_freq", "off_ppp",
        "off_ppp_pctl", "def_n", "def_ppp", "def_ppp_pctl",
    )
