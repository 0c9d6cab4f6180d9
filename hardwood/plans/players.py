"""Player season table, percentiles and the roster-joined dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.functions.metrics import floor_at_zero, position_group, ratio, used_possessions
from hardwood.operators.aggregates import latest_attributes
from hardwood.operators.filters import clean_player_box, minimum_sample
from hardwood.operators.percentiles import group_averages, weighted_percentiles
from hardwood.operators.reshape import keep_first
from hardwood.plans.teams import player_team_games, team_totals
from hardwood.schemas import PLAYER_COUNTS
from hardwood.session import materialize, steps

# output percentile -> (value, weight)
PERCENTILE_SPECS = {
    "usage_pctile_pos": ("usage", "usg_weight"),
    "ts_pctile_pos": ("ts_pct", "ts_weight"),
    "efg_pctile_pos": ("efg_pct", "efg_weight"),
    "ast_pctile_pos": ("ast_pct", "ast_weight"),
    "stl_pctile_pos": ("spg", "stl_weight"),
    "tov_pctile_pos": ("tov_pct", "tov_weight"),
    "oreb_pctile_pos": ("oreb_pct", "oreb_weight"),
    "dreb_pctile_pos": ("dreb_pct", "dreb_weight"),
    "fg3_pctile_pos": ("fg3_pct", "fg3_weight"),
    "ft_pctile_pos": ("ft_pct", "ft_weight"),
    "threepar_pctile_pos": ("threepar", "threepar_weight"),
    "fta_rate_pctile_pos": ("fta_rate", "fta_rate_weight"),
}
DEFENSE_SPECS = {
    "def_efg_pctile_pos": ("neg_opp_efg", "minutes_total"),
    "def_tov_pctile_pos": ("opp_tov_pct", "minutes_total"),
}
PER_GAME = {
    "mpg": "minutes", "ppg": "pts", "rpg": "reb", "apg": "ast", "spg": "stl", "bpg": "blk",
    "tovpg": "tov", "oreb_pg": "oreb", "dreb_pg": "dreb",
}
#: Number of a row of the stored season table.
ROW = "_row"
PER_MINUTES = ["pts", "reb", "ast", "stl", "blk", "tov", "oreb", "dreb"]


def defensive_context(clean: DataFrame, paired: DataFrame, by: Sequence[str] = ("season", "athlete_id")) -> DataFrame:
    """Opponent shooting and turnovers over the games a player appeared in."""
    opp = paired.select(
        "season", "game_id", "team_id",
        *[F.col(f"opp_team_{c}").alias(f"_o_{c}") for c in ("fgm", "fg3m", "fga", "fta", "tov")],
    )
    g = clean.select("season", "game_id", "team_id", "athlete_id").join(
        opp, ["season", "game_id", "team_id"], "left"
    ).groupBy(*by).agg(*[F.sum(f"_o_{c}").alias(f"_o_{c}") for c in ("fgm", "fg3m", "fga", "fta", "tov")])
    return g.select(
        *by,
        ratio(F.col("_o_fgm") + F.lit(0.5) * F.col("_o_fg3m"), "_o_fga").alias("opp_efg"),
        ratio("_o_tov", used_possessions("_o_fga", "_o_fta", "_o_tov")).alias("opp_tov_pct"),
    )


def season_totals(clean: DataFrame, keys: Sequence[str] = ("season", "athlete_id"), together: bool = False) -> DataFrame:
    """Counting totals with the attributes of the player's last row by date.

    `together`: a player's rows mostly lie together in the box, so their sums are half made before the exchange, and the games
    travel as a set. Otherwise the box is dealt by player first, and the count of games needs no exchange of half-made sums.
    """
    attributes = [a for a in ("athlete_name", "position_raw", "team_id") if a in clean.columns]
    games = F.size(F.collect_set("game_id")).cast("bigint") if together else F.countDistinct("game_id")
    return (clean if together else clean.repartition(*keys)).groupBy(*keys).agg(
        *latest_attributes(clean, keys, attributes, ["game_date", "seq", "team_id"]),
        games.alias("games_played"),
        F.sum(F.when(F.col("starter"), 1).otherwise(0)).alias("games_started"),
        F.sum("minutes").alias("minutes_total"),
        *[F.sum(c).alias(f"{c}_total") for c in PLAYER_COUNTS],
    )


def add_player_rates(df: DataFrame, per: int = 36) -> DataFrame:
    """Per-game, per-minutes, shooting and floor-time rates; expects player and team totals."""
    c = F.col
    fga, fta, tov = c("fga_total"), c("fta_total"), c("tov_total")
    used = used_possessions("fga_total", "fta_total", "tov_total")
    team_used = used_possessions("team_fga_total", "team_fta_total", "team_tov_total")
    floor_share = F.when(c("team_minutes_total") != 0, c("minutes_total") / (c("team_minutes_total") / 5))
    ts_load = fga + F.lit(0.44) * fta
    out = df.withColumns({
        **{k: c(f"{v}_total") / c("games_played") for k, v in PER_GAME.items()},
        "fg_pct": ratio("fgm_total", fga),
        "fg3_pct": ratio("fg3m_total", "fg3a_total"),
        "ft_pct": ratio("ftm_total", fta),
        "efg_pct": ratio(c("fgm_total") + F.lit(0.5) * c("fg3m_total"), fga),
        "ts_pct": F.when(ts_load > 0, c("pts_total") / (F.lit(2.0) * ts_load)),
        **{f"{s}_per_{per}": ratio(c(f"{s}_total") * per, "minutes_total") for s in PER_MINUTES},
        "usg_weight": floor_at_zero(used),
        "usage": F.when(
            (c("minutes_total") > 0) & (team_used > 0),
            (used * (c("team_minutes_total") / 5)) / (c("minutes_total") * team_used),
        ),
        "ast_denom": floor_share * c("team_fgm_total") - c("fgm_total"),
        "tov_denom": used,
        "oreb_chances": floor_share * (c("team_oreb_total") + c("opp_dreb_total")),
        "dreb_chances": floor_share * (c("team_dreb_total") + c("opp_oreb_total")),
        "threepar": ratio("fg3a_total", fga),
        "fta_rate": ratio("fta_total", fga),
    })
    played = c("minutes_total") > 0
    return out.withColumns({
        "ast_pct": ratio("ast_total", "ast_denom", played & (c("team_minutes_total") > 0)),
        "tov_pct": ratio("tov_total", "tov_denom"),
        "oreb_pct": ratio("oreb_total", "oreb_chances", played),
        "dreb_pct": ratio("dreb_total", "dreb_chances", played),
        "ts_weight": floor_at_zero(ts_load),
        "efg_weight": floor_at_zero(fga),
        "ast_weight": floor_at_zero("ast_denom"),
        "stl_weight": floor_at_zero("minutes_total"),
        "tov_weight": floor_at_zero("tov_denom"),
        "oreb_weight": floor_at_zero("oreb_chances"),
        "dreb_weight": floor_at_zero("dreb_chances"),
        "fg3_weight": floor_at_zero("fg3a_total"),
        "ft_weight": floor_at_zero("fta_total"),
        "threepar_weight": floor_at_zero(fga),
        "fta_rate_weight": floor_at_zero(fga),
    })


def player_season(player_box: DataFrame, per: int = 36, honour_dnp: bool = True, collapse: bool = True) -> DataFrame:
    """One row per player and season with totals, rates and defensive context."""
    clean = clean_player_box(player_box, honour_dnp)
    _, paired, team_season = team_totals(player_box, honour_dnp)
    return _season_rows(season_totals(clean), team_season, defensive_context(clean, paired), per, collapse)


def _season_rows(totals: DataFrame, team_season: DataFrame, context: DataFrame, per: int, collapse: bool) -> DataFrame:
    named = totals.withColumn("position", position_group("position_raw") if collapse else F.col("position_raw"))
    joined = named.join(team_season, ["season", "team_id"], "left").join(context, ["season", "athlete_id"], "left")
    return add_player_rates(joined, per).withColumn("neg_opp_efg", -F.col("opp_efg"))


def staged_player_season(
    player_box: DataFrame, per: int = 36, honour_dnp: bool = True, collapse: bool = True, named: bool = True,
) -> DataFrame:
    """The season table over stored steps, so that no more than one step's exchanges are on disk at a time.

    The box is read for totals, team games and their opponents: what it is made of is joined once. `named=False` leaves out
    the players' names.
    """
    clean = clean_player_box(player_box, honour_dnp)
    box = materialize(clean if named else clean.drop("athlete_name"))
    with steps(keep=2):
        game = materialize(player_team_games(box, honour_dnp))
        _, paired, team_season = team_totals(box, honour_dnp, game)
        team_season = materialize(team_season)  # a row per team: Spark sees that before it joins the players to it
        context = materialize(defensive_context(box, paired))
    return _season_rows(season_totals(box, together=True), team_season, context, per, collapse)


def stored_player_season(player_box: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """The season table (or the named columns) written once: ranking reads it several times and it is far smaller than the box.

    Its rows are numbered (`ROW`): a number is shorter than a season and a player's id.
    """
    with steps():
        season = staged_player_season(player_box, named=columns is None or "athlete_name" in columns, **kw)
        kept = season if columns is None else season.select(*dict.fromkeys(columns))
        return materialize(kept.withColumn(ROW, F.monotonically_increasing_id()))


def percentile_columns(specs: dict[str, tuple] | None = None) -> list[str]:
    """What percentiles in a position need of the season table."""
    specs = specs or {**PERCENTILE_SPECS, **DEFENSE_SPECS}
    return list(dict.fromkeys(["season", "athlete_id", "position", *[c for pair in specs.values() for c in pair]]))


def player_percentiles(
    season: DataFrame, group: Sequence[str] = ("position",), specs: dict | None = None,
) -> DataFrame:
    """Weighted percentiles inside the group; ties run in (season, numeric athlete) order."""
    specs = specs or {**PERCENTILE_SPECS, **DEFENSE_SPECS}
    return weighted_percentiles(
        season, specs, list(group), ["season", "athlete_id"],
        [F.col("season"), F.col("athlete_id").cast("bigint")], ROW if ROW in season.columns else None,
    )


def position_averages(season: DataFrame, group: Sequence[str] = ("position",)) -> DataFrame:
    """Long (metric, group, avg, avg_percentile)."""
    return group_averages(season, PERCENTILE_SPECS, list(group), ["season", "athlete_id"])


def with_position_averages(season: DataFrame, group: str = "position", of: DataFrame | None = None) -> DataFrame:
    """Averages (of the rows of `of`, else of `season`) and their percentiles put back on the player rows."""
    long = position_averages(season if of is None else of, [group])
    wide = long.groupBy(group).pivot("metric", list(PERCENTILE_SPECS)).agg(
        F.first("avg").alias("pos_avg"), F.first("avg_percentile").alias("pos_avg_pctile")
    )
    named = wide.select(F.col(group).alias("_g"), *[c for c in wide.columns if c != group])
    return season.join(F.broadcast(named), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")  # one row per position


def roster_player_box(player_box: DataFrame, roster: DataFrame) -> DataFrame:
    """Box rows with the roster position where known, else the box position, plus season starts."""
    one = keep_first(
        roster.select("athlete_id", F.col("position").alias("_roster_pos"), "roster_gp", "roster_gs"),
        ["athlete_id"], ["_roster_pos", "roster_gp", "roster_gs"],
    )
    return player_box.join(one, "athlete_id", "left").withColumn(
        "position_raw", F.coalesce("_roster_pos", "position_raw")
    ).drop("_roster_pos")


def division_dataset(
    player_box: DataFrame, roster: DataFrame, teams: DataFrame | None = None, min_games: int = 1,
) -> DataFrame:
    """Box and roster joined, kept teams only, per-40 season table; starts come from the roster."""
    box = roster_player_box(player_box, roster)
    if teams is not None:
        box = box.join(teams.select("team_id").distinct(), "team_id", "left_semi")
    season = player_season(box, per=40, honour_dnp=False, collapse=False)
    starts = box.groupBy("season", "athlete_id").agg(F.min("roster_gs").alias("games_started_season"))
    return minimum_sample(season.join(starts, ["season", "athlete_id"], "left"), games_played=min_games)
