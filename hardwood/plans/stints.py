"""Lineup stints as a window plan.

A player's place on the floor is decided by that player's own latest substitution, so each player
has on/off intervals in stint numbers; spreading an interval over its stints gives exactly the
five (or broken) lineups, with no walk over the game and no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.functions.arrays import lineup_set, lineup_slots
from hardwood.functions.clock import period_seconds, seconds_to_clock
from hardwood.operators import events as E

MAX_UNRESOLVED = 0.10


def stint_events(pbp: DataFrame) -> DataFrame:
    """Ordered events with substitution groups and the number of the running stint."""
    c = F.col
    ev = E.substitution_groups(E.event_flags(E.order_events(pbp))).where(c("period_number").isNotNull())
    period = Window.partitionBy("game_id", "period_number")
    ev = ev.withColumns({
        "p_first": c("idx") == F.min("idx").over(period),
        "p_last": c("idx") == F.max("idx").over(period),
    })
    # a period's first event opens a stint, and so does the end of every substitution group
    opens = c("p_first").cast("int") + c("grp_end").cast("int")
    return ev.withColumn(
        "stint_no",
        (F.coalesce(F.sum(opens).over(E.before()), F.lit(0)) + c("p_first").cast("int")).cast("int"),
    ).withColumn("side_ok", F.coalesce(
        (c("team_id") == c("home_team_id")) | (c("team_id") == c("away_team_id")), F.lit(False)
    ))


def stint_spans(ev: DataFrame) -> DataFrame:
    """Start, end and points of every stint."""
    c = F.col
    game = ["game_id", "league", "game_date", "home_team_id", "away_team_id", "home_team_abbrev", "away_team_abbrev"]
    scored = c("side_ok") & ~c("is_sub") & (c("made") | X.matches("text", "makes"))
    worth = F.when(c("score_value") > 0, c("score_value")).otherwise(X.inferred_points("text").cast("double"))
    pts = lambda side: F.when(scored & (c("team_id") == c(side)), worth).otherwise(0.0)
    none = F.lit(None).cast("double")

    def part(no, start=none, end=none, home=F.lit(0.0), away=F.lit(0.0), closed=F.lit(False)):
        return F.struct(
            no.cast("int").alias("stint_no"), start.alias("start_secs"), end.alias("end_secs"),
            home.alias("home_pts"), away.alias("away_pts"), closed.alias("closed"),
        )

    length = period_seconds("league", "period_number").cast("double")
    parts = F.array_compact(F.array(
        F.when(c("p_first"), part(c("stint_no"), start=length)),
        F.when(c("grp_start"), part(c("stint_no"), end=c("secs"), closed=F.lit(True))),
        F.when(scored, part(c("stint_no"), home=pts("home_team_id"), away=pts("away_team_id"))),
        F.when(c("grp_end"), part(c("stint_no") + 1, start=c("secs"))),
        F.when(c("p_last"), part(c("stint_no") + c("grp_end").cast("int"), end=F.lit(0.0), closed=F.lit(True))),
    ))
    return ev.select(*game, "period_number", F.inline(parts)).groupBy(*game, "period_number", "stint_no").agg(
        F.max("start_secs").alias("start_secs"), F.max("end_secs").alias("end_secs"),
        F.sum("home_pts").alias("home_pts"), F.sum("away_pts").alias("away_pts"),
    )


def player_moves(ev: DataFrame, starters: DataFrame) -> DataFrame:
    """On/off moves per player with the first stint they apply to."""
    c = F.col
    move = lambda player, on, k: F.struct(player.alias("player"), F.lit(on).alias("on"), F.lit(k).alias("step"))
    subs = ev.where(c("is_sub") & c("side_ok") & c("sub_dir").isNotNull()).select(
        "game_id", "team_id", (c("stint_no") + 1).alias("from_stint"), "idx",
        F.inline(F.when(
            c("sub_dir") == "paired", F.array(move(c("athlete_id_2"), False, 0), move(c("athlete_id_1"), True, 1))
        ).when(
            c("sub_dir") == "in", F.array(move(c("athlete_id_1"), True, 0))
        ).otherwise(F.array(move(c("athlete_id_1"), False, 0)))),
    )
    start = starters.where(F.coalesce(c("starter"), F.lit(False))).select(
        "game_id", "team_id", F.lit(1).alias("from_stint"), F.lit(0).alias("idx"),
        c("athlete_id").alias("player"), F.lit(True).alias("on"), F.lit(0).alias("step"),
    )
    moves = subs.unionByName(start)
    w = Window.partitionBy("game_id", "team_id", "player").orderBy("idx", "step")
    return moves.withColumns({
        "was_on": F.coalesce(F.lag("on").over(w), F.lit(False)),
        "until_stint": F.lead("from_stint").over(w),
    })


def stint_quality(ev: DataFrame, moves: DataFrame) -> DataFrame:
    """Substitution counters per game: unresolved, phantom and reopened."""
    c = F.col
    prev = lambda x: F.coalesce(F.lag(x).over(E.game_window()), F.lit(False))
    q = ev.withColumn("_inner", c("is_sub") & ~c("grp_start") & prev("grp_start") & ~prev("grp_end")).groupBy("game_id").agg(
        F.sum(c("is_sub").cast("int")).alias("n_subs"),
        F.sum((c("is_sub") & (c("sub_dir").isNull() | ~c("side_ok"))).cast("int")).alias("n_unresolved"),
        F.sum(c("_inner").cast("int")).alias("n_reopened"),
        F.max("stint_no").alias("n_stints"),
    )
    ghosts = moves.where((c("idx") > 0) & ~c("on") & ~c("was_on")).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_phantom")
    )
    return q.join(ghosts, "game_id", "left").fillna(0, ["n_phantom"]).withColumn(
        "failed", F.coalesce(c("n_unresolved") > MAX_UNRESOLVED * c("n_subs"), F.lit(False))
    )


def _build(pbp: DataFrame, starters: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = F.col
    ev = stint_events(pbp)
    spans = stint_spans(ev)
    moves = player_moves(ev, starters)
    quality = stint_quality(ev, moves)
    last = spans.groupBy("game_id").agg(F.max("stint_no").alias("_last"))
    end = F.coalesce(c("until_stint") - 1, c("_last"))
    members = (
        moves.where("on").join(last, "game_id").where(c("from_stint") <= end)
        .select("game_id", "team_id", "player", F.explode(F.sequence("from_stint", end)).alias("stint_no"))
        .groupBy("game_id", "team_id", "stint_no").agg(F.collect_set("player").alias("players"))
    )
    sides = spans.select(
        "game_id", "game_date", "stint_no", c("period_number").alias("period"), "start_secs",
        F.coalesce("end_secs", "start_secs").alias("end_secs"),
        F.inline(F.array(
            F.struct(c("home_team_id").alias("team_id"), c("home_team_abbrev").alias("team"), c("away_team_abbrev").alias("opponent"),
                     c("home_pts").cast("int").alias("team_pts"), c("away_pts").cast("int").alias("opp_pts")),
            F.struct(c("away_team_id").alias("team_id"), c("away_team_abbrev").alias("team"), c("home_team_abbrev").alias("opponent"),
                     c("away_pts").cast("int").alias("team_pts"), c("home_pts").cast("int").alias("opp_pts")),
        )),
    )
    rows = sides.join(members, ["game_id", "team_id", "stint_no"], "left").withColumn(
        "five", F.coalesce(lineup_set("players"), F.array().cast("array<string>"))
    )
    span = c("start_secs") - c("end_secs")
    table = rows.join(quality.select("game_id", "failed"), "game_id").where(~c("failed")).select(
        "game_id", "team", "opponent", c("game_date").alias("date"), c("stint_no").alias("stint_id"), "period",
        seconds_to_clock("start_secs").alias("clock_start"), seconds_to_clock("end_secs").alias("clock_end"),
        *lineup_slots("five"), "team_pts", "opp_pts",
        F.when(span < 0, 0.0).otherwise(span).alias("stint_seconds"), (F.size("five") == 5).alias("lineup_valid"),
    )
    return table, quality


def lineup_stints(pbp: DataFrame, starters: DataFrame) -> DataFrame:
    """Two rows per stint for every game whose substitutions could be resolved."""
    return _build(pbp, starters)[0]


def stint_report(pbp: DataFrame, starters: DataFrame) -> DataFrame:
    """Per-game counters; failed games are the dead letters of `lineup_stints`."""
    return _build(pbp, starters)[1]


def team_stints(stints: DataFrame, team: str | None = None, min_seconds: float = 0.0) -> DataFrame:
    out = stints.where(F.col("stint_seconds") >= min_seconds)
    if team is not None:
        out = out.where(F.col("team") == team)
    return out.withColumn("plus_minus", F.col("team_pts") - F.col("opp_pts"))
