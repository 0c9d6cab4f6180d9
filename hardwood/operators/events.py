"""Play-by-play: feed order, event flags and ordered-window features.

Every window is keyed by the game, which is a few hundred events, so one hash exchange on
game_id (`spread`, in `order_events`) serves the whole chain. Look-ahead is written as a running last over the reversed order
because a frame that ends at the partition's end is re-read for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.functions.clock import clock_to_seconds, round_half_even
from hardwood.session import spread

FIRST = Window.unboundedPreceding


def game_window(*order: Column) -> Window:
    return Window.partitionBy("game_id").orderBy(*(order or (F.col("idx"),)))


def before() -> Window:
    return game_window().rowsBetween(FIRST, -1)


def after() -> Window:
    """Rows after the current one, nearest last."""
    return game_window(F.col("idx").desc()).rowsBetween(FIRST, -1)


def order_events(pbp: DataFrame, feed_order: str = "sequence_number") -> DataFrame:
    """Row index in game order: period, clock falling (unparseable last), sequence."""
    raw = clock_to_seconds("clock_display_value")
    w = game_window(
        F.col("period_number").asc_nulls_last(), F.col("_raw_secs").desc_nulls_last(), F.col(feed_order).asc_nulls_last(),
    )
    return (
        spread(pbp, "game_id").withColumn("_raw_secs", raw)
        .withColumn("idx", F.row_number().over(w))
        .withColumn("secs", round_half_even("_raw_secs"))
        .drop("_raw_secs")
    )


def event_flags(events: DataFrame) -> DataFrame:
    """Event family flags; `made` comes from the scoring flag, never from the text."""
    blob = F.col("_blob")
    made = X.truthy("scoring_play", dict(events.dtypes).get("scoring_play", "boolean"))
    out = events.withColumn("_blob", X.event_blob())
    out = out.withColumns({
        "ft": X.matches(blob, X.P_FREE_THROW),
        "reb": X.matches(blob, X.P_REBOUND),
        "oreb": X.matches(blob, X.P_OFF_REBOUND),
        "stl": X.matches(blob, X.P_STEAL),
        "tov": X.matches(blob, X.P_TURNOVER),
        "made": made,
        "is_three": X.is_three_point(),
    })
    shot_words = X.matches(blob, X.P_SHOT)
    out = out.withColumns({
        "dreb": F.col("reb") & ~F.col("oreb") & ~X.matches(blob, X.P_DEAD_BALL),
        "shot": shot_words & ~F.col("reb") & ~F.col("ft"),
        "profile_shot": shot_words & ~X.matches(blob, X.P_PROFILE_NOT_SHOT),
        "assisted": X.matches("text", "assist"),
        "foul": X.matches(blob, X.P_FOUL) & ~F.col("ft"),
        "live": (
            shot_words | (F.col("reb") & ~X.matches(blob, X.P_DEAD_REBOUND)) | F.col("tov")
        ) & ~F.col("ft"),
    })
    return out.withColumn("ball", F.col("shot") | F.col("reb") | F.col("tov") | F.col("ft")).drop("_blob")


def last_free_throw(events: DataFrame) -> DataFrame:
    """`last_ft`: stated 'n of n', or not followed by a free throw of the same team."""
    k, n = X.free_throw_count("text")
    nxt = F.last(
        F.when(F.col("ball"), F.struct("ft", "team_id")), ignorenulls=True
    ).over(after())
    out = events.withColumns({"_ft_k": k, "_ft_n": n, "_next": nxt})
    same_trip = F.coalesce(F.col("_next.ft") & (F.col("_next.team_id") == F.col("team_id")), F.lit(False))
    stated = F.col("_ft_k").isNotNull() & F.col("_ft_n").isNotNull()
    return out.withColumn(
        "last_ft",
        F.col("ft") & F.when(stated, F.col("_ft_k") == F.col("_ft_n")).otherwise(~same_trip),
    ).drop("_ft_k", "_ft_n", "_next")


def steal_nearby(events: DataFrame) -> DataFrame:
    """Any steal among the previous, the current and the next row."""
    return events.withColumn("stl_near", F.max("stl").over(game_window().rowsBetween(-1, 1)))


def fill_score(events: DataFrame, column: str, out: str) -> DataFrame:
    """Last known value; a leading gap takes the first known one, no value at all is zero."""
    seen = F.last(column, ignorenulls=True).over(game_window().rowsBetween(FIRST, 0))
    first = F.min_by(column, F.when(F.col(column).isNotNull(), F.col("idx"))).over(Window.partitionBy("game_id"))
    return events.withColumn(out, F.coalesce(seen, first, F.lit(0)))


def free_throw_trips(events: DataFrame) -> DataFrame:
    """Free throws numbered inside their trip.

    A new trip starts when live play or a foul happened since the previous free throw, when the
    team changes or is unknown, or when both shooters are known and differ.
    """
    counts = events.withColumns({
        "_live": F.sum(F.col("live").cast("int")).over(game_window().rowsBetween(FIRST, 0)),
        "_foul": F.sum(F.col("foul").cast("int")).over(game_window().rowsBetween(FIRST, 0)),
    }).where("ft")
    w = game_window()
    prev = lambda c: F.lag(c).over(w)
    same_team = F.coalesce(F.col("team_id") == prev("team_id"), F.lit(False))
    other_shooter = F.coalesce(F.col("athlete_id_1") != prev("athlete_id_1"), F.lit(False))
    fresh = (
        prev("idx").isNull() | (F.col("_live") > prev("_live")) | (F.col("_foul") > prev("_foul"))
        | ~same_team | other_shooter
    )
    k, n = X.free_throw_count("text")
    trips = counts.withColumn("_new", fresh.cast("int")).withColumn(
        "trip_id", F.sum("_new").over(w.rowsBetween(FIRST, 0)).cast("int")
    )
    in_trip = Window.partitionBy("game_id", "trip_id")
    return trips.withColumns({
        "shot_num": F.row_number().over(in_trip.orderBy("idx")),
        "trip_size": F.count(F.lit(1)).over(in_trip).cast("int"),
        "txt_shot": k, "txt_of": n,
    }).drop("_live", "_foul", "_new")


def trip_agreement(trips: DataFrame) -> DataFrame:
    """Share of stated free throws whose derived number and size agree with the text."""
    ok = (F.col("shot_num") == F.col("txt_shot")) & (F.col("trip_size") == F.col("txt_of"))
    return trips.where(F.col("txt_shot").isNotNull() & F.col("txt_of").isNotNull()).agg(
        F.count(F.lit(1)).alias("stated"), F.avg(ok.cast("double")).alias("agreement")
    )


def substitution_groups(events: DataFrame) -> DataFrame:
    """Direction and group borders of substitution rows.

    Rows of one period and clock form a group; a paired row is a group of its own, which also
    ends the run before it and starts the run after it.
    """
    w = game_window()
    out = events.withColumn("is_sub", X.substitution_flag())
    out = out.withColumn("sub_dir", X.substitution_direction("is_sub", "text", "athlete_id_1", "athlete_id_2"))
    out = out.withColumns({
        "_key": F.when(F.col("is_sub"), F.concat_ws(
            " ", F.coalesce(F.col("period_number").cast("string"), F.lit("NA")),
            F.coalesce(F.col("secs").cast("string"), F.lit("NA")))),
        "_paired": F.coalesce(F.col("sub_dir") == "paired", F.lit(False)),
    })
    edge = lambda fn: F.coalesce(fn("_key").over(w) != F.col("_key"), F.lit(True)) | F.coalesce(fn("_paired").over(w), F.lit(False))
    return out.withColumns({
        "grp_start": F.col("is_sub") & (F.col("_paired") | edge(F.lag)),
        "grp_end": F.col("is_sub") & (F.col("_paired") | edge(F.lead)),
    }).drop("_key", "_paired")


def known_team(events: DataFrame) -> DataFrame:
    """Team abbreviation of each row; one unknown id is resolved when only one side was seen."""
    g = events.groupBy("game_id").agg(
        F.collect_set("team_id").alias("_seen"),
        F.first("home_team_id").alias("_h"), F.first("away_team_id").alias("_a"),
        F.first("home_team_abbrev").alias("_ha"), F.first("away_team_abbrev").alias("_aa"),
    )
    sides = F.array("_h", "_a")
    g = g.withColumns({
        "_unknown": F.array_except("_seen", sides), "_known": F.array_intersect("_seen", sides),
    }).select(
        "game_id", "_h", "_a", "_ha", "_aa",
        F.when((F.size("_unknown") == 1) & (F.size("_known") == 1), F.get("_unknown", F.lit(0))).alias("_odd"),
        F.get("_known", F.lit(0)).alias("_one"),
    )
    t = F.col("team_id")
    name = (
        F.when(t == F.col("_h"), F.col("_ha")).when(t == F.col("_a"), F.col("_aa"))
        .when(t == F.col("_odd"), F.when(F.col("_one") == F.col("_h"), F.col("_aa")).otherwise(F.col("_ha")))
    )
    return events.join(g, "game_id").withColumn("team_abbrev", name).drop("_h", "_a", "_ha", "_aa", "_odd", "_one")


def other_team(team: str = "team_id") -> Column:
    return F.when(F.col(team) == F.col("home_team_id"), F.col("away_team_id")).when(
        F.col(team) == F.col("away_team_id"), F.col("home_team_id")
    )


def side_abbrev(team: Column) -> Column:
    return F.when(team == F.col("home_team_id"), F.col("home_team_abbrev")).when(
        team == F.col("away_team_id"), F.col("away_team_abbrev")
    )
