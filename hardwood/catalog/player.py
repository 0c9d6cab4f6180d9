"""Player box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.registry import query
from hardwood.catalog.season import _CONF
from hardwood.catalog.team import _TEAM_GAME
from hardwood.functions.metrics import position_group_listed
from hardwood.functions.text import build_url, clean_number, expand_position, parse_minutes, short_name, slug
from hardwood.operators.filters import clean_player_box, find_team, round_numeric, suggest_names
from hardwood.operators.percentiles import percent_ranks, tercile_band
from hardwood.operators.quantiles import exact_quantiles
from hardwood.operators.reshape import radar_rows
from hardwood.plans import players, teams
from hardwood.plans.season import team_conferences
from hardwood.session import materialize, steps

_TOTALS = ["pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf"]

# clean rows, last attributes and totals per player season
_PLAYER = _TEAM_GAME + f""",
 cl AS (SELECT * FROM player_box WHERE minutes > 0 AND NOT coalesce(did_not_play, false)),
 la AS (SELECT season, athlete_id, athlete_name, position_raw, team_id FROM (
          SELECT *, row_number() OVER (PARTITION BY season, athlete_id ORDER BY game_date DESC, seq DESC, team_id DESC) AS rn FROM cl) q WHERE rn = 1),
 tt AS (SELECT season, athlete_id, count(DISTINCT game_id) AS games_played,
          cast(sum(CASE WHEN starter THEN 1 ELSE 0 END) AS bigint) AS games_started, sum(minutes) AS minutes_total,
          {", ".join(f"sum({c}) AS {c}_total" for c in _TOTALS)} FROM cl GROUP BY season, athlete_id),
 dc AS (SELECT cl.season, cl.athlete_id,
          (sum(tp.opp_fgm) + 0.5e0 * sum(tp.opp_fg3m)) / nullif(sum(tp.opp_fga), 0) AS opp_efg,
          sum(tp.opp_tov) / nullif(sum(tp.opp_fga) + 0.44e0 * sum(tp.opp_fta) + sum(tp.opp_tov), 0) AS opp_tov_pct
        FROM cl LEFT JOIN tp ON cl.season = tp.season AND cl.game_id = tp.game_id AND cl.team_id = tp.team_id
        GROUP BY cl.season, cl.athlete_id),
 pj AS (SELECT tt.*, la.athlete_name, la.position_raw, la.team_id,
          CASE WHEN contains(position_raw, 'G') THEN 'G' WHEN contains(position_raw, 'F') THEN 'F' WHEN position_raw = 'C' THEN 'C' END AS position,
          t_minutes, t_fgm, t_fga, t_fta, t_tov, t_oreb, t_dreb, o_oreb, o_dreb, opp_efg, opp_tov_pct
        FROM tt JOIN la ON tt.season = la.season AND tt.athlete_id = la.athlete_id
        LEFT JOIN ts ON ts.season = la.season AND ts.team_id = la.team_id
        LEFT JOIN dc ON dc.season = tt.season AND dc.athlete_id = tt.athlete_id),
 pr AS (SELECT *, fga_total + 0.44e0 * fta_total + tov_total AS used, t_fga + 0.44e0 * t_fta + t_tov AS t_used,
          (minutes_total / (nullif(t_minutes, 0) / 5)) * t_fgm - fgm_total AS ast_denom,
          (minutes_total / (nullif(t_minutes, 0) / 5)) * (t_oreb + o_dreb) AS oreb_chances,
          (minutes_total / (nullif(t_minutes, 0) / 5)) * (t_dreb + o_oreb) AS dreb_chances FROM pj),
 ps AS (SELECT *, stl_total / games_played AS spg,
          CASE WHEN t_used > 0 AND minutes_total > 0 THEN (used * (t_minutes / 5)) / (minutes_total * t_used) END AS usage,
          CASE WHEN fga_total + 0.44e0 * fta_total > 0 THEN pts_total / (2e0 * (fga_total + 0.44e0 * fta_total)) END AS ts_pct,
          CASE WHEN fga_total > 0 THEN (fgm_total + 0.5e0 * fg3m_total) / fga_total END AS efg_pct,
          CASE WHEN ast_denom > 0 AND minutes_total > 0 AND t_minutes > 0 THEN ast_total / ast_denom END AS ast_pct,
          CASE WHEN used > 0 THEN tov_total / used END AS tov_pct,
          CASE WHEN oreb_chances > 0 THEN oreb_total / oreb_chances END AS oreb_pct,
          CASE WHEN dreb_chances > 0 THEN dreb_total / dreb_chances END AS dreb_pct,
          CASE WHEN fg3a_total > 0 THEN fg3m_total / fg3a_total END AS fg3_pct,
          CASE WHEN fta_total > 0 THEN ftm_total / fta_total END AS ft_pct,
          CASE WHEN fga_total > 0 THEN fg3a_total / fga_total END AS threepar,
          CASE WHEN fga_total > 0 THEN fta_total / fga_total END AS fta_rate,
          -opp_efg AS neg_opp_efg FROM pr)"""

_SPECS = {
    "usage_pctile_pos": ("usage", "used"), "ts_pctile_pos": ("ts_pct", "(fga_total + 0.44e0 * fta_total)"),
    "efg_pctile_pos": ("efg_pct", "fga_total"), "ast_pctile_pos": ("ast_pct", "CASE WHEN ast_denom < 0 THEN 0 ELSE ast_denom END"),
    "stl_pctile_pos": ("spg", "minutes_total"), "tov_pctile_pos": ("tov_pct", "used"),
    "oreb_pctile_pos": ("oreb_pct", "oreb_chances"), "dreb_pctile_pos": ("dreb_pct", "dreb_chances"),
    "fg3_pctile_pos": ("fg3_pct", "fg3a_total"), "ft_pctile_pos": ("ft_pct", "fta_total"),
    "threepar_pctile_pos": ("threepar", "fga_total"), "fta_rate_pctile_pos": ("fta_rate", "fga_total"),
    "def_efg_pctile_pos": ("neg_opp_efg", "minutes_total"), "def_tov_pctile_pos": ("opp_tov_pct", "minutes_total"),
}


def pct_sql(group: str, digits: int = 8) -> str:
    out = []
    for name, (x, w) in _SPECS.items():
        part = f"PARTITION BY {group}, {x} IS NULL"
        out.append(
            f"round(CASE WHEN {x} IS NOT NULL AND sum(coalesce({w}, 0)) OVER ({part}) > 0 THEN "
            f"sum(coalesce({w}, 0)) OVER ({part} ORDER BY {x}, season, cast(athlete_id AS bigint) ROWS UNBOUNDED PRECEDING) "
            f"/ sum(coalesce({w}, 0)) OVER ({part}) END, {digits}) AS {name}"
        )
    return ",\n".join(out)


_RATES = [
    "usage", "ts_pct", "efg_pct", "ast_pct", "tov_pct", "oreb_pct", "dreb_pct", "fg3_pct", "ft_pct",
    "threepar", "fta_rate", "opp_efg", "opp_tov_pct",
]


@query(
    "player_season", ("player_box",),
    _PLAYER + " SELECT season, athlete_id, athlete_name, position, team_id, games_played, games_started, minutes_total, pts_total, "
    + ", ".join(_RATES) + " FROM ps",
)
def player_season(t):
    return players.staged_player_season(t.player_box_by_player).select(
        "season", "athlete_id", "athlete_name", "position", "team_id", "games_played", "games_started",
        "minutes_total", "pts_total", *_RATES,
    )


@query(
    "player_per_minute", ("player_box",),
    _PLAYER + """ SELECT season, athlete_id, minutes_total / games_played AS mpg, pts_total / games_played AS ppg, reb_total / games_played AS rpg,
      CASE WHEN minutes_total > 0 THEN pts_total * 40 / minutes_total END AS pts_per_40,
      CASE WHEN minutes_total > 0 THEN tov_total * 40 / minutes_total END AS tov_per_40,
      CASE WHEN minutes_total > 0 THEN dreb_total * 40 / minutes_total END AS dreb_per_40,
      CASE WHEN fga_total > 0 THEN fgm_total / fga_total END AS fg_pct FROM ps""",
)
def player_per_minute(t):
    return players.player_season(t.player_box, per=40).select(
        "season", "athlete_id", "mpg", "ppg", "rpg", "pts_per_40", "tov_per_40", "dreb_per_40", "fg_pct"
    )


@query(
    "defensive_context", ("player_box",),
    _PLAYER + " SELECT season, athlete_id, opp_efg, opp_tov_pct FROM dc",
)
def defensive_context(t):
    clean = clean_player_box(t.player_box)
    _, paired, _ = teams.team_totals(t.player_box)
    return players.defensive_context(clean, paired)


@query(
    "weighted_percentile_pos", ("player_box",),
    _PLAYER + f" SELECT season, athlete_id, {pct_sql('position')} FROM ps",
)
def weighted_percentile_pos(t):
    out = players.player_percentiles(players.stored_player_season(t.player_box_by_player, players.percentile_columns()))
    return out.select("season", "athlete_id", *[F.round(c, 8).alias(c) for c in _SPECS])


_AVG = " UNION ALL ".join(
    f"""SELECT '{n}' AS metric, position, round(avg, 8) AS avg,
        round((sum(CASE WHEN x <= avg THEN coalesce(w, 0) ELSE 0 END) + mw) / (sum(CASE WHEN x IS NOT NULL THEN coalesce(w, 0) END) + mw), 8) AS avg_percentile
        FROM (SELECT position, {x} AS x, {w} AS w, avg({w}) OVER g AS mw,
                     sum(CASE WHEN {w} > 0 AND {x} IS NOT NULL THEN {x} * {w} END) OVER g
                     / sum(CASE WHEN {w} > 0 AND {x} IS NOT NULL THEN {w} END) OVER g AS avg
              FROM ps WINDOW g AS (PARTITION BY position)) q GROUP BY position, avg, mw"""
    for n, (x, w) in _SPECS.items() if not n.startswith("def_")
)


@query("position_average_pctile", ("player_box",), _PLAYER + " " + _AVG)
def position_average_pctile(t):
    a = players.position_averages(players.stored_player_season(t.player_box_by_player))
    return a.select("metric", "position", F.round("avg", 8).alias("avg"), F.round("avg_percentile", 8).alias("avg_percentile"))


_SLICES = {
    "Usage": "usage", "True shooting": "ts", "Effective FG": "efg", "Assist rate": "ast", "Turnover care": "tov",
    "Offensive glass": "oreb", "Defensive glass": "dreb", "Free throws": "ft",
}


def _flip(label: str, c: str) -> str:
    return f"1e0 - {c}" if label == "Turnover care" else c


@query(
    "pizza_long", ("player_box",),
    _PLAYER + f", pp AS (SELECT season, athlete_id, position, {pct_sql('position', 15)} FROM ps), av AS ({_AVG}) "
    + " UNION ALL ".join(
        f"""SELECT season, athlete_id, pp.position, {i} AS slice_order, '{label}' AS label,
            round(coalesce({_flip(label, s + '_pctile_pos')}, 0e0), 6) AS player_pct,
            round({_flip(label, 'av.avg_percentile')}, 6) AS average_pct
            FROM pp LEFT JOIN av ON pp.position IS NOT DISTINCT FROM av.position AND av.metric = '{s}_pctile_pos'"""
        for i, (label, s) in enumerate(_SLICES.items(), 1)
    ),
)
def pizza_long(t):
    stored = players.stored_player_season(t.player_box_by_player, players.percentile_columns(players.PERCENTILE_SPECS))
    season = players.player_percentiles(stored, specs=players.PERCENTILE_SPECS)
    full = players.with_position_averages(season, of=stored)
    slices = {k: (f"{s}_pctile_pos", f"{s}_pctile_pos_pos_avg_pctile") for k, s in _SLICES.items()}
    rows = radar_rows(full, ["season", "athlete_id", "position"], slices, ["Turnover care"])
    return rows.select(
        "season", "athlete_id", "position", "slice_order", "label",
        F.round("player_pct", 6).alias("player_pct"), F.round("average_pct", 6).alias("average_pct"),
    )


def _rank_sql(metrics, group: str | None) -> str:
    rows = []
    for m in metrics:
        part = f"PARTITION BY {group + ',' if group else ''} {m} IS NULL"
        alone = "0.5e0" if group else "0e0"
        rows.append(
            f"SELECT season, athlete_id, {group + ',' if group else ''} '{m}' AS metric, {m} AS x, CASE WHEN {m} IS NULL THEN NULL "
            f"WHEN count(*) OVER ({part}) = 1 THEN {alone} ELSE percent_rank() OVER ({part} ORDER BY {m}) END AS pct FROM ps"
        )
    return " UNION ALL ".join(rows)


_BANDED = ["pts_total", "tov_total", "fg3_pct", "usage", "threepar"]
_DIRECTION = {"pts_total": "up", "tov_total": "down", "fg3_pct": "up", "usage": "neutral", "threepar": "neutral"}
_DIR_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DIRECTION.items()) + " END"


def _banded(ranks):
    d = None
    for k, v in _DIRECTION.items():
        d = F.when(F.col("metric") == k, v) if d is None else d.when(F.col("metric") == k, v)
    return ranks.withColumn("band", tercile_band("pct")).withColumn("direction", d)


@query(
    "percent_rank_bands", ("player_box",),
    _PLAYER + f", r AS ({_rank_sql(_BANDED, 'position')}) SELECT *, CASE WHEN pct <= 1e0/3 THEN 1 WHEN pct <= 2e0/3 THEN 2 WHEN pct IS NOT NULL THEN 3 END AS band, {_DIR_SQL} AS direction FROM r",
)
def percent_rank_bands(t):
    s = players.stored_player_season(t.player_box_by_player, ["season", "athlete_id", "position", *_BANDED])
    return _banded(percent_ranks(s, _BANDED, ["position"], ["season", "athlete_id"], lone=0.5))


@query(
    "percent_rank_columns", ("player_box",),
    _PLAYER + f", r AS ({_rank_sql(_BANDED, None)}) SELECT *, CASE WHEN pct <= 1e0/3 THEN 1 WHEN pct <= 2e0/3 THEN 2 WHEN pct IS NOT NULL THEN 3 END AS band, {_DIR_SQL} AS direction FROM r",
)
def percent_rank_columns(t):
    s = players.stored_player_season(t.player_box_by_player, ["season", "athlete_id", *_BANDED])
    return _banded(percent_ranks(s, _BANDED, [], ["season", "athlete_id"]))


@query(
    "percentiles_in_conference", ("player_box", "schedule"),
    _PLAYER + _CONF + f""", pc AS (SELECT ps.*, tc.conf FROM ps LEFT JOIN tc ON tc.team_id = ps.team_id) SELECT season, athlete_id, conf, position, {pct_sql('conf, position')} FROM pc""",
)
def percentiles_in_conference(t):
    """Percentiles among the players of a position in a conference."""
    conf = materialize(team_conferences(t.schedule).select(F.col("team_id").alias("_team"), "conf"))
    with steps():
        s = players.stored_player_season(t.player_box_by_player, [*players.percentile_columns(), "team_id"])
        s = materialize(s.join(conf, F.col("team_id") == F.col("_team"), "left").drop("_team"))
    out = players.player_percentiles(s, ["conf", "position"])
    return out.select("season", "athlete_id", "conf", "position", *[F.round(c, 8).alias(c) for c in _SPECS])


@query(
    "position_medians", ("player_box",),
    _PLAYER + """ SELECT position, median(pts_total) AS median_pts, quantile_cont(usage, 0.9) AS usage_p90, round(avg(minutes_total / games_played), 2) AS mpg, round(avg(pts_total / games_played), 6) AS ppg, round(avg(ast_total / games_played), 6) AS apg,
                  round(avg(stl_total / games_played), 6) AS spg, round(avg(usage), 6) AS usage_mean, round(avg(efg_pct), 6) AS efg_mean,
                  count(*) AS players, count(DISTINCT team_id) AS teams FROM ps GROUP BY position""",
)
def position_medians(t):
    s = players.stored_player_season(t.player_box_by_player)
    asked = {"median_pts": ("pts_total", 0.5), "usage_p90": ("usage", 0.9)}
    quantiles = exact_quantiles(s, asked, ["position"], ["season", "athlete_id"]).withColumnRenamed("position", "_position")
    counts = s.groupBy("position").agg(
        F.bround(F.avg("mpg"), 2).alias("mpg"), *[F.round(F.avg(c), 6).alias(c) for c in ("ppg", "apg", "spg")],
        *[F.round(F.avg(c), 6).alias(f"{n}_mean") for n, c in (("usage", "usage"), ("efg", "efg_pct"))], F.count(F.lit(1)).alias("players"), F.countDistinct("team_id").alias("teams"),
    )
    return counts.join(quantiles, F.col("position").eqNullSafe(F.col("_position")), "left").drop("_position")


@query(
    "division_dataset", ("player_box", "roster"),
    """, box AS (SELECT b.* EXCLUDE (position_raw), coalesce(r.position, b.position_raw) AS position_raw, r.roster_gs FROM player_box b
                 LEFT JOIN roster r ON b.athlete_id = r.athlete_id WHERE b.minutes > 0),
     la AS (SELECT season, athlete_id, position_raw AS position, team_id FROM (SELECT *, row_number() OVER (PARTITION BY season, athlete_id
              ORDER BY game_date DESC, seq DESC, team_id DESC) AS rn FROM box) q WHERE rn = 1)
     SELECT b.season, b.athlete_id, la.position, la.team_id, count(DISTINCT b.game_id) AS games_played, min(b.roster_gs) AS games_started_season,
            round_even(sum(b.pts) * 40 / sum(b.minutes), 3) AS pts_per_40, round_even((sum(b.fgm) + 0.5e0 * sum(b.fg3m)) / nullif(sum(b.fga), 0), 3) AS efg_pct
     FROM box b JOIN la ON b.season = la.season AND b.athlete_id = la.athlete_id
     GROUP BY b.season, b.athlete_id, la.position, la.team_id HAVING count(DISTINCT b.game_id) >= 2""",
)
def division_dataset(t):
    d = players.division_dataset(t.player_box, t.roster, min_games=2)
    out = d.select(
        "season", "athlete_id", "position", "team_id", "games_played", "games_started_season", "pts_per_40", "efg_pct"
    )
    return round_numeric(out, 3, skip=["games_started_season"])


@query(
    "games_started_check", ("player_box",),
    """, g AS (SELECT season, team_id, count(DISTINCT game_id) AS games, cast(sum(CASE WHEN starter THEN 1 ELSE 0 END) AS bigint) AS starts, sum(minutes) AS minutes
              FROM player_box WHERE minutes > 0 GROUP BY season, team_id)
       SELECT season, team_id, games, starts, starts - 5 * games AS starts_gap, minutes / games >= 190 AS minutes_ok FROM g""",
)
def games_started_check(t):
    """Starts against five per game and minutes against a full game."""
    g = clean_player_box(t.player_box, honour_dnp=False).groupBy("season", "team_id").agg(
        F.countDistinct("game_id").alias("games"),
        F.sum(F.when(F.col("starter"), 1).otherwise(0)).alias("starts"), F.sum("minutes").alias("minutes"),
    )
    return g.select(
        "season", "team_id", "games", "starts", (F.col("starts") - 5 * F.col("games")).alias("starts_gap"),
        (F.col("minutes") / F.col("games") >= 190).alias("minutes_ok"),
    )


@query(
    "text_fields", ("roster",),
    """ SELECT athlete_id, CASE WHEN contains(full_name, ' ') THEN concat(left(full_name, 1), '. ', split_part(full_name, ' ', 2)) ELSE full_name END AS short_name,
         CASE position WHEN 'G' THEN 'Guard' WHEN 'F' THEN 'Forward' WHEN 'C' THEN 'Center' WHEN 'G/F' THEN 'Guard/Forward' END AS position_name,
         CASE WHEN position IN ('F', 'SF', 'PF', 'F-C') THEN 'Forward' WHEN position = 'C' THEN 'Center' ELSE 'Guard' END AS bucket,
         replace(full_name, ' ', '_') AS slug, concat('https://images.example.org/', athlete_id, '.png') AS photo_url,
         cast(athlete_id AS bigint) % 40 + (cast(athlete_id AS bigint) % 60) / 60e0 AS minutes, cast(athlete_id AS double) AS cleaned
         FROM roster""",
)
def text_fields(t):
    n = F.col("athlete_id").cast("bigint")
    clock = F.format_string("%d:%02d", n % 40, n % 60)
    return t.roster.select(
        "athlete_id", short_name("full_name").alias("short_name"), expand_position("position").alias("position_name"),
        position_group_listed("position").alias("bucket"), slug("full_name").alias("slug"),
        build_url("https://images.example.org/", "athlete_id", ".png").alias("photo_url"),
        parse_minutes(clock).alias("minutes"), clean_number(F.concat(F.lit("#"), "athlete_id", F.lit(" pts"))).alias("cleaned"),
    )


@query(
    "name_suggestions", (),
    """SELECT p_name, levenshtein(lower(p_name), 'blue bolt') AS distance FROM (SELECT DISTINCT p_name FROM part) q
       WHERE levenshtein(lower(p_name), 'blue bolt') <= 3 ORDER BY distance, p_name LIMIT 5""",
)
def name_suggestions(t):
    return suggest_names(t.part, "blue bolt", "p_name")


@query(
    "team_lookup", ("schedule",),
    """, n AS (SELECT home_display_name AS team_name FROM schedule UNION SELECT away_display_name FROM schedule),
       m AS (SELECT team_name, lower(team_name) = 'team 1' AS exact FROM n WHERE contains(lower(team_name), 'team 1'))
       SELECT team_name FROM m WHERE exact OR NOT (SELECT bool_or(exact) FROM m)""",
)
def team_lookup(t):
    names = t.schedule.select(F.explode(F.array("home_display_name", "away_display_name")).alias("team_name")).distinct()
    return find_team(names, "Team 1")
