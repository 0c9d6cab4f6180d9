"""Season summary and population queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.profile import CATEGORIES
from hardwood.catalog.registry import query
from hardwood.plans.profile import category_rows
from hardwood.plans import season as SE
from hardwood.sources.resolve import resolve_games

# every team plays for the same league here, so the summary is per season and team
BY = ["season", "team"]


def _long(cut: str = "") -> str:
    return f""", sc AS (SELECT *, 40e0 + (greatest(coalesce(status_period, 4), 4) - 4) * 5e0 AS minutes FROM schedule WHERE status_type_completed {cut}),
 lg AS (SELECT game_id, season, game_date, minutes, home_abbreviation AS team, home_score AS pts, away_score AS opp_pts, home_score > away_score AS won FROM sc
   UNION ALL SELECT game_id, season, game_date, minutes, away_abbreviation, away_score, home_score, away_score > home_score FROM sc),
 bs AS (SELECT season, team, count(*) AS games, cast(sum(won::int) AS bigint) AS wins, cast(sum((NOT won)::int) AS bigint) AS losses, sum(minutes) AS minutes,
   avg(pts) AS pts_per_game, avg(opp_pts) AS opp_pts_per_game FROM lg GROUP BY 1, 2),
 fm AS (SELECT season, team, count(*) AS k, cast(sum(won::int) AS bigint) AS w FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY game_date DESC, game_id) AS rn FROM lg) q
   WHERE rn <= 5 GROUP BY 1, 2),
 bx AS (SELECT season, game_id, concat('T', team_id) AS team, fga, fgm, fg3m, fta, oreb, dreb, tov FROM team_box WHERE true {cut}),
 ff AS (SELECT a.season, a.team, sum(a.fga) + 0.44e0 * sum(a.fta) + sum(a.tov) - sum(a.oreb) AS bp, sum(b.fga) + 0.44e0 * sum(b.fta) + sum(b.tov) - sum(b.oreb) AS op,
   (sum(a.fgm) + 0.5e0 * sum(a.fg3m)) / nullif(sum(a.fga), 0) AS efg, sum(a.tov) AS tov, sum(b.tov) AS otov, sum(a.oreb) / nullif(sum(a.oreb) + sum(b.dreb), 0) AS orb_pct,
   sum(a.fta) / nullif(sum(a.fga), 0) AS ft_rate, (sum(b.fgm) + 0.5e0 * sum(b.fg3m)) / nullif(sum(b.fga), 0) AS def_efg
   FROM bx a JOIN bx b ON a.game_id = b.game_id AND a.team <> b.team GROUP BY 1, 2)"""


_SUMMARY = """ SELECT bs.season, bs.team, games, wins, losses, minutes, round(pts_per_game, 8) AS pts_per_game, concat(wins, '-', losses) AS record,
   wins / cast(games AS double) AS win_pct, round(pts_per_game - opp_pts_per_game, 8) AS margin, concat(w, '-', k - w) AS last_n_record,
   efg, tov / bp AS tov_pct, orb_pct, ft_rate, def_efg, otov / op AS opp_tov_pct, {pace}
   FROM bs JOIN fm ON bs.season = fm.season AND bs.team = fm.team LEFT JOIN ff ON ff.season = bs.season AND ff.team = bs.team {extra}"""
_COLS = ["season", "team", "games", "wins", "losses", "minutes", "pts_per_game", "record", "win_pct", "margin", "last_n_record",
         "efg", "tov_pct", "orb_pct", "ft_rate", "def_efg", "opp_tov_pct", "possessions", "pace"]


def _box(t):
    return t.team_box.withColumn("team", F.concat(F.lit("T"), "team_id"))


def _tidy(df):
    return df.select(*[F.round(c, 8).alias(c) if c in ("pts_per_game", "margin") else F.col(c) for c in _COLS])


@query("season_summary", ("schedule",), _long() + _SUMMARY.format(pace="NULL::bigint AS possessions, NULL::double AS pace", extra=""))
def season_summary(t):
    """Orders have no possessions, so no pace here; see season_pace."""
    return _tidy(SE.season_summary(t.schedule, "wnba", _box(t), by=BY))


@query(
    "season_summary_as_of", ("schedule",),
    _long("AND game_date <= DATE '1999-03-31'")
    + _SUMMARY.format(pace="NULL::bigint AS possessions, NULL::double AS pace", extra=""),
)
def season_summary_as_of(t):
    return _tidy(SE.season_summary(t.schedule, "wnba", _box(t), as_of="1999-03-31", by=BY))


# the event feed has games, scores and possessions of four leagues
SCOPED = ["league", "season", "team"]
PACE = CATEGORIES + """, sc AS (SELECT *, CASE league WHEN 'nba' THEN 48e0 + (greatest(coalesce(status_period, 4), 4) - 4) * 5e0
     WHEN 'mbb' THEN 40e0 + (greatest(coalesce(status_period, 2), 2) - 2) * 5e0 ELSE 40e0 + (greatest(coalesce(status_period, 4), 4) - 4) * 5e0 END AS minutes FROM event_schedule),
 lg AS (SELECT league, season, minutes, home_abbreviation AS team, home_score AS pts, away_score AS opp_pts FROM sc
   UNION ALL SELECT league, season, minutes, away_abbreviation, away_score, home_score FROM sc),
 bs AS (SELECT league, season, team, count(*) AS games, count(*) FILTER (pts > opp_pts) AS wins, sum(minutes) AS minutes, avg(pts) - avg(opp_pts) AS margin
   FROM lg WHERE pts IS NOT NULL AND opp_pts IS NOT NULL GROUP BY 1, 2, 3),
 pc AS (SELECT league, season, off_team AS team, count(*) AS possessions FROM ca WHERE dimension = 'context' GROUP BY 1, 2, 3),
 pace AS (SELECT bs.*, possessions, possessions / minutes * CASE bs.league WHEN 'nba' THEN 48e0 ELSE 40e0 END AS pace
   FROM bs LEFT JOIN pc ON pc.league = bs.league AND pc.season = bs.season AND pc.team = bs.team)"""


def _event_season(t):
    counts = category_rows(t.pbp).withColumnsRenamed({"off_team": "team", "n": "off_n"})
    return SE.season_summary(t.event_schedule, None, profile=counts, by=SCOPED)


@query("season_pace", ("pbp", "event_schedule"), PACE + " SELECT league, season, team, games, wins, minutes, possessions, round(pace, 8) AS pace FROM pace")
def season_pace(t):
    return _event_season(t).select(*SCOPED, "games", "wins", "minutes", "possessions", F.round("pace", 8).alias("pace"))


@query(
    "header_stats", ("pbp", "event_schedule"),
    PACE + """ SELECT league, season, team, concat(wins, '-', games - wins) AS record,
      CASE WHEN margin < 0 AND round_even(margin, 1) = 0 THEN '-0.0' ELSE printf('%+.1f', round_even(margin, 1)) END AS margin,
      printf('%.1f', round_even(pace, 1)) AS pace FROM pace""",
)
def header_stats(t):
    return SE.header_stats(_event_season(t)).select(*SCOPED, "record", "margin", "pace")


_CONF = """, sd AS (SELECT home_id AS team_id, home_abbreviation AS team, home_display_name AS name, home_conference_id AS conf_id FROM schedule
   UNION ALL SELECT away_id, away_abbreviation, away_display_name, away_conference_id FROM schedule),
 ct AS (SELECT team_id, team, name, conf_id, count(*) AS n FROM sd GROUP BY ALL),
 bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, team, name, conf_id) AS rn FROM ct) q WHERE rn = 1),
 cn AS (SELECT groups_id AS conf_id, min(groups_short_name) AS conf FROM schedule WHERE groups_id IS NOT NULL GROUP BY 1),
 tc AS (SELECT bt.team_id, bt.team, bt.name, bt.conf_id, cn.conf FROM bt LEFT JOIN cn ON bt.conf_id = cn.conf_id)"""


@query("conference_mode", ("schedule",), _CONF + " SELECT team_id, team, name, conf_id, conf FROM tc")
def conference_mode(t):
    return SE.team_conferences(t.schedule)


def _custom(t):
    return t.spark.createDataFrame(
        [("lakes", "Lake league", "wbb", ["Team 1", "Team 7", "Team 12", "Nowhere College"])],
        "key string, label string, league string, schools array<string>",
    )


@query(
    "population_teams", ("schedule",),
    _CONF + """ SELECT 'national' AS population, team FROM tc UNION ALL SELECT 'asia', team FROM tc WHERE regexp_matches(conf, 'asia', 'i')
      UNION ALL SELECT 'own', team FROM tc WHERE conf = (SELECT conf FROM tc WHERE team = 'T3') UNION ALL SELECT 'lakes', team FROM tc WHERE name IN ('Team 1', 'Team 7', 'Team 12')""",
)
def population_teams(t):
    s, custom = t.schedule, _custom(t)
    tag = lambda name, df: df.select(F.lit(name).alias("population"), "team")
    return (
        tag("national", SE.population(s, "national")).unionByName(tag("asia", SE.population(s, "asia")))
        .unionByName(tag("own", SE.population(s, "conference", "t3")))
        .unionByName(tag("lakes", SE.population(s, "lakes", custom=custom)))
    )


@query(
    "conference_list", ("schedule",),
    _CONF + """ SELECT conf AS key, count(*) AS teams, conf AS label, 'feed' AS source FROM tc WHERE conf IS NOT NULL GROUP BY conf
      UNION ALL SELECT 'lakes', 4, 'Lake league', 'custom'""",
)
def conference_list(t):
    return SE.conference_list(SE.team_conferences(t.schedule), _custom(t))


@query(
    "scheduled_teams", ("schedule",),
    """, s AS (SELECT home_abbreviation AS team FROM schedule UNION ALL SELECT away_abbreviation FROM schedule)
      SELECT team, count(*) AS games FROM s GROUP BY team HAVING count(*) >= 270""",
)
def scheduled_teams(t):
    return SE.scheduled_teams(t.schedule, 270)


@query(
    "resolve_games", ("schedule",),
    """ SELECT DISTINCT game_id, game_date FROM schedule WHERE status_type_completed AND (lower(home_abbreviation) = 't17' OR lower(away_abbreviation) = 't17')
      AND game_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""",
)
def resolved(t):
    return resolve_games(t.schedule, "t17", "1996-01-01", "1997-06-30")


_ASKED = [
    ("national", None, None), ("asia", None, None), ("conference", "t3", None), ("lakes", None, "wbb"), ("lakes", None, "nba"), ("atlantis", None, None), ("conference", "t9999", None),
]


@query(
    "population_report", ("schedule",),
    _CONF + """, known AS (SELECT string_agg(key, ', ' ORDER BY key) AS k FROM (SELECT DISTINCT conf AS key FROM tc WHERE conf IS NOT NULL UNION SELECT 'lakes') q)
      SELECT 'national' AS population, NULL::varchar AS team, NULL::varchar AS league, count(*) AS teams, NULL::varchar AS unresolved, NULL::varchar AS error FROM tc
      UNION ALL SELECT 'asia', NULL, NULL, count(*), NULL, NULL FROM tc WHERE regexp_matches(conf, 'asia', 'i')
      UNION ALL SELECT 'conference', 't3', NULL, count(*), NULL, NULL FROM tc WHERE conf = (SELECT conf FROM tc WHERE team = 'T3')
      UNION ALL SELECT 'lakes', NULL, 'wbb', count(*), (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT unnest(['Team 1', 'Team 7', 'Team 12', 'Nowhere College']) AS x) q WHERE x NOT IN (SELECT name FROM tc)), NULL
        FROM tc WHERE name IN ('Team 1', 'Team 7', 'Team 12')
      UNION ALL SELECT 'lakes', NULL, 'nba', 0, NULL, 'list ''lakes'' is of league ''wbb'', not ''nba'''
      UNION ALL SELECT 'atlantis', NULL, NULL, 0, NULL, concat('no team in ''atlantis''; there are: ', k) FROM known
      UNION ALL SELECT 'conference', 't9999', NULL, 0, NULL, 'no team ''t9999'' in the schedule'""",
)
def population_report(t):
    """Populations that are found, with schools that aren't, and the errors of those that can't be."""
    return SE.population_report(t.schedule, _ASKED, _custom(t))
