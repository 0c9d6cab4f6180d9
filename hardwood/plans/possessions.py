"""Possessions, possession states and game-state moments as window plans.

Who has the ball after an event depends only on that event: a defensive rebound leaves it with
the rebounder; a turnover, a made field goal and a made last free throw leave it with the other
side. So the offence before any row is the last such event of the period (else the first team to
touch the ball), which a running window gives; no per-row loop is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.clock import seconds_left_in_game, seconds_to_clock
from hardwood.functions.metrics import league_rule
from hardwood.operators import events as E
from hardwood.schemas import LIVE_BALL_STARTS, TRANSITION_SECONDS

# State names and the columns of a possession.
START_STATE = {
    "made_fg": "after_made_fg", "made_ft": "after_made_ft", "dreb": "after_dreb",
    "steal": "after_steal", "turnover": "after_turnover", "period_start": "period_start",
}
POSSESSION_COLUMNS = [
    "game_id", "period", "poss_id", "off_team", "def_team", "clock_start", "clock_end", "seconds",
    "points", "context", "start_reason", "end_reason", "had_oreb", "start_idx", "end_idx",
]


def prepared_events(pbp: DataFrame) -> DataFrame:
    """Ordered and flagged events with filled scores, ready for every walk."""
    ev = E.steal_nearby(E.last_free_throw(E.event_flags(E.order_events(pbp))))
    return E.fill_score(E.fill_score(ev, "home_score", "home_fill"), "away_score", "away_fill")


def possession_rows(events: DataFrame) -> DataFrame:
    """Events with the possession they fall in and what they do to it."""
    c = F.col
    period = Window.partitionBy("game_id", "period_number")
    run = period.orderBy("idx")
    upto, earlier = run.rowsBetween(E.FIRST, 0), run.rowsBetween(E.FIRST, -1)
    game = Window.partitionBy("game_id")

    ev = events.withColumn("_n_rows", F.count(F.lit(1)).over(game)).withColumn(
        "_last_period", F.max("period_number").over(game)
    )
    ev = ev.withColumn(
        "_period_end_idx",
        F.when(c("period_number") == c("_last_period"), c("_n_rows")).otherwise(F.max("idx").over(period)).cast("int"),
    )
    side = (c("team_id") == c("home_team_id")) | (c("team_id") == c("away_team_id"))
    ev = ev.withColumn("_side", F.coalesce(side, F.lit(False)) & c("period_number").isNotNull())
    # the first team to touch the ball opens the period
    ev = ev.withColumn("_touch", c("_side") & c("ball"))
    ev = ev.withColumn("_open", c("_side") & F.coalesce(F.max("_touch").over(upto), F.lit(False)))
    ev = ev.withColumn("_first", c("_open") & ~F.coalesce(F.max("_touch").over(earlier), F.lit(False)))

    other = E.other_team()
    fg = c("made") & ~c("ft")
    gives = (
        F.when(~c("_open"), None)
        .when(c("oreb"), F.when(c("_first"), c("team_id")))
        .when(c("dreb"), c("team_id"))
        .when(c("tov") | fg | (c("made") & c("last_ft")), other)
        .when(c("_first"), c("team_id"))
    )
    ev = ev.withColumn("_gives", gives)
    ev = ev.withColumn(
        "off", F.when(c("_first"), c("team_id")).otherwise(F.last("_gives", ignorenulls=True).over(earlier))
    )
    mine = c("team_id") == c("off")
    ev = ev.withColumn("_mine", F.coalesce(c("_open") & mine, F.lit(False)))
    ends = (
        F.when(~c("_open") | c("oreb"), None)
        .when(c("dreb"), F.when(~c("_mine"), "dreb"))
        .when(c("tov"), "turnover")
        .when(fg, "made_fg")
        .when(c("made") & c("last_ft") & c("_mine"), "made_ft")
    )
    ev = ev.withColumn("ends", ends)
    opened = c("_first").cast("int") + c("ends").isNotNull().cast("int")
    count_before = F.coalesce(F.sum(opened).over(E.before()), F.lit(0)) + c("_first").cast("int")
    in_play = c("_open") | (F.coalesce(F.max("_touch").over(upto), F.lit(False)) & c("period_number").isNotNull())
    ev = ev.withColumn(
        "poss_id", F.when(in_play | c("period_number").isNull(), F.nullif(count_before, F.lit(0))).cast("int")
    )
    # a scorer is owed a bonus free throw until live play resumes
    owed = F.when(c("ends") == "made_fg", c("team_id")).when(
        c("_open") & (c("shot") | c("reb") | c("tov")), F.lit("")
    )
    ev = ev.withColumn("_owed", F.last(owed, ignorenulls=True).over(E.before()))
    worth = F.when(c("score_value") > 0, c("score_value")).when(c("ft"), 1.0).otherwise(2.0)
    scored = c("_open") & c("made")
    bonus = scored & ~c("_mine") & c("ft") & F.coalesce(c("_owed") == c("team_id"), F.lit(False)) & (c("poss_id") > 1)
    return ev.withColumns({
        "own_pts": F.when(scored & c("_mine"), worth).otherwise(0.0),
        "bonus_pts": F.when(bonus, worth).otherwise(0.0),
        "lost_pts": F.when(scored & ~c("_mine") & ~bonus, worth).otherwise(0.0),
        "first_shot": F.when(c("_mine") & c("shot"), c("secs")),
        "own_oreb": c("_mine") & c("oreb"),
        "home_prev": F.lag("home_fill").over(E.game_window()),
        "away_prev": F.lag("away_fill").over(E.game_window()),
    })


def _possession_facts(rows: DataFrame) -> DataFrame:
    """One row per possession from its opening, closing and inner events."""
    c = F.col
    null = lambda t: F.lit(None).cast(t)
    inner = F.struct(
        c("poss_id").alias("poss_id"), null("string").alias("o_reason"), null("string").alias("o_off"),
        null("double").alias("o_secs"), null("int").alias("o_idx"), null("int").alias("o_home"), null("int").alias("o_away"),
        c("own_pts").alias("own"), c("bonus_pts").alias("bonus"), c("lost_pts").alias("lost"),
        c("first_shot").alias("shot_secs"), c("own_oreb").alias("oreb"),
        c("ends").alias("e_reason"), F.when(c("ends").isNotNull(), c("secs")).alias("e_secs"),
        F.when(c("ends").isNotNull(), c("idx")).alias("e_idx"),
    )

    def opening(pid, reason, off, home, away):
        return F.struct(
            pid.cast("int").alias("poss_id"), reason.alias("o_reason"), off.alias("o_off"),
            c("secs").alias("o_secs"), c("idx").alias("o_idx"), home.cast("int").alias("o_home"), away.cast("int").alias("o_away"),
            F.lit(0.0).alias("own"), F.lit(0.0).alias("bonus"), F.lit(0.0).alias("lost"),
            null("double").alias("shot_secs"), F.lit(False).alias("oreb"),
            null("string").alias("e_reason"), null("double").alias("e_secs"), null("int").alias("e_idx"),
        )

    game_opener = c("idx") <= 1
    at_start = opening(
        c("poss_id"), F.lit("period_start"), c("team_id"),
        F.when(game_opener, 0).otherwise(c("home_prev")), F.when(game_opener, 0).otherwise(c("away_prev")),
    )
    reason = F.when(c("ends") == "turnover", F.when(c("stl_near"), "steal").otherwise("turnover")).otherwise(c("ends"))
    taker = F.when(c("ends") == "dreb", c("team_id")).otherwise(E.other_team())
    after_end = opening(c("poss_id") + 1, reason, taker, c("home_fill"), c("away_fill"))
    parts = F.array_compact(F.array(
        inner, F.when(c("_first"), at_start), F.when(c("ends").isNotNull(), after_end)
    ))
    keep = ["game_id", "league", *_season(rows), "period_number", "_period_end_idx", "home_team_id", "away_team_id",
            "home_team_abbrev", "away_team_abbrev"]
    flat = rows.where("_open").select(*keep, F.inline(parts))
    g = flat.groupBy(*keep, "poss_id").agg(
        *[F.max(x).alias(x) for x in ("o_reason", "o_off", "o_secs", "o_idx", "o_home", "o_away", "e_reason", "e_secs", "e_idx", "shot_secs")],
        F.sum("own").alias("own"), F.sum("bonus").alias("bonus"), F.sum("lost").alias("lost"), F.max("oreb").alias("had_oreb"),
    )
    # a bonus free throw shot during a possession belongs to the one closed before it
    w = Window.partitionBy("game_id").orderBy("poss_id")
    return g.withColumn("points", (c("own") + F.coalesce(F.lead("bonus").over(w), F.lit(0.0))).cast("int"))


def _season(rows: DataFrame) -> list[str]:
    """The season key, for feeds of several seasons."""
    return ["season"] if "season" in rows.columns else []


def possession_state(rows: DataFrame) -> DataFrame:
    """Possessions with the score, margin and time left at their start, from `possession_rows`."""
    c = F.col
    f = _possession_facts(rows)
    end_secs = F.when(c("e_reason").isNull(), F.lit(0.0)).otherwise(F.coalesce("e_secs", "o_secs"))
    quick = (c("o_secs") - c("shot_secs")) <= TRANSITION_SECONDS
    context = (
        F.when(c("had_oreb"), "second_chance")
        .when(c("o_reason").isin(LIVE_BALL_STARTS) & F.coalesce(quick, F.lit(False)), "transition")
        .otherwise("halfcourt")
    )
    off_home = c("o_off") == c("home_team_id")
    margin = c("o_home") - c("o_away")
    span = c("o_secs") - end_secs
    return f.select(
        "league", *_season(rows), "game_id", c("period_number").alias("period"), "poss_id",
        E.side_abbrev(c("o_off")).alias("off_team"),
        F.when(off_home, c("away_team_abbrev")).otherwise(c("home_team_abbrev")).alias("def_team"),
        seconds_to_clock("o_secs").alias("clock_start"), seconds_to_clock(end_secs).alias("clock_end"),
        F.when(span < 0, 0.0).otherwise(span).alias("seconds"), "points", context.alias("context"),
        c("o_reason").alias("start_reason"), F.coalesce("e_reason", F.lit("period_end")).alias("end_reason"),
        "had_oreb", c("o_idx").cast("int").alias("start_idx"),
        F.coalesce("e_idx", "_period_end_idx").cast("int").alias("end_idx"),
        off_home.alias("off_is_home"), c("o_secs").cast("int").alias("secs_left_period"),
        seconds_left_in_game("league", c("period_number"), c("o_secs")).cast("int").alias("secs_left_game"),
        (c("period_number") > league_rule("league", "reg_periods")).alias("is_ot"),
        c("o_home").alias("home_score"), c("o_away").alias("away_score"), margin.alias("home_margin"),
        F.when(off_home, margin).otherwise(-margin).alias("off_margin"), c("lost").alias("uncredited"),
    )


def possessions(pbp: DataFrame) -> DataFrame:
    return possession_state(possession_rows(prepared_events(pbp))).select(*POSSESSION_COLUMNS)


def uncredited_points(pbp: DataFrame) -> DataFrame:
    """Points per game that no possession could take, for data-quality reports."""
    return possession_rows(prepared_events(pbp)).groupBy("game_id").agg(F.sum("lost_pts").alias("uncredited"))


def game_states(rows: DataFrame) -> DataFrame:
    """Possession starts (pure) and free-throw moments in one table, from `possession_rows`.

    A free throw sees the filled score of the row before it, so no moment lacks a score.
    """
    c = F.col
    state = F.create_map(*[F.lit(x) for kv in START_STATE.items() for x in kv])
    none = F.lit(None).cast("int")
    pure = possession_state(rows).select(
        "game_id", "poss_id", "period", "is_ot", "secs_left_period", "secs_left_game",
        F.lit("possession").alias("state_type"), state[c("start_reason")].alias("state"), F.lit(True).alias("is_pure"),
        c("off_team").alias("ball_team"), c("off_is_home").alias("ball_is_home"), "home_score", "away_score", "home_margin",
        c("off_margin").alias("ball_margin"), none.alias("ft_shot_num"), none.alias("ft_trip_size"),
        none.alias("ft_shots_remaining"), c("start_idx").alias("idx"),
    )
    trips = E.free_throw_trips(E.known_team(rows))
    home = F.coalesce(c("home_prev"), F.lit(0)).cast("int")
    away = F.coalesce(c("away_prev"), F.lit(0)).cast("int")
    is_home = c("team_abbrev") == c("home_team_abbrev")
    ft = trips.select(
        "game_id", "poss_id", c("period_number").alias("period"),
        (c("period_number") > league_rule("league", "reg_periods")).alias("is_ot"),
        c("secs").cast("int").alias("secs_left_period"),
        seconds_left_in_game("league", c("period_number"), c("secs")).cast("int").alias("secs_left_game"),
        F.lit("free_throw").alias("state_type"),
        F.format_string("ft_%d_of_%d", "shot_num", "trip_size").alias("state"), F.lit(False).alias("is_pure"),
        c("team_abbrev").alias("ball_team"), is_home.alias("ball_is_home"), home.alias("home_score"), away.alias("away_score"),
        (home - away).alias("home_margin"), F.when(is_home, home - away).otherwise(away - home).alias("ball_margin"),
        c("shot_num").alias("ft_shot_num"), c("trip_size").alias("ft_trip_size"),
        (c("trip_size") - c("shot_num") + 1).alias("ft_shots_remaining"), "idx",
    )
    return pure.unionByName(ft)
