"""Basketball-shaped views over the generic order and event tables.

Each view is one SQL text in the subset that Spark and DuckDB read alike, so a result can be
checked against an independent engine on identical input. Every row of a source table is read. There are at
most 360 teams. The game of an event is its user's slot (of 150) in its block of 10,000 event ids: that
block is part of the game key, so no game has more events however skewed the users are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.session import spread

# An order is a game and its odd and even lines are the two sides. Every line counts: a side's figures are made of the
# sums over its lines. Its team is that of its smallest supplier, so both sides can name one team (no pair then), and an
# order with one line is a game with one side.
_TEAM_SIDES = """
SELECT game_id, side, min(l_suppkey) AS team_no, count(*) AS n_lines,
       cast(sum(l_quantity) AS double) AS quantity, cast(sum(l_partkey) AS bigint) AS parts, cast(sum(l_suppkey) AS bigint) AS suppliers
FROM (
  SELECT cast(l_orderkey AS string) AS game_id, l_partkey, l_suppkey, l_quantity, 2 - l_linenumber % 2 AS side
  FROM {lineitem}
) keyed
GROUP BY game_id, side
"""

_TEAM_BOX = """
SELECT game_id,
       cast(team_no % 360 AS string) AS team_id,
       cast(year(o_orderdate) AS int) AS season,
       cast(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 5 ELSE 2 END AS int) AS season_type,
       cast(o_orderdate AS date) AS game_date,
       CASE WHEN side = 1 THEN 'home' ELSE 'away' END AS team_home_away,
       2 * fgm + fg3m + floor(0.7e0 * fta) AS pts,
       fga, fgm, fg3m, fta, oreb, dreb, tov
FROM (
  SELECT s.game_id, s.team_no, s.side, o.o_orderdate, o.o_orderpriority,
         fga, floor(0.3e0 * fga) + cast(parts % 12 AS double) AS fgm,
         cast(parts % 11 AS double) AS fg3m,
         cast(10 + suppliers % 17 AS double) AS fta,
         cast(4 + parts % 9 AS double) AS oreb,
         cast(20 + 2 * n_lines AS double) AS dreb,
         cast(8 + parts % 7 AS double) AS tov
  FROM (SELECT *, 45 + floor(0.3e0 * quantity) AS fga FROM {team_sides}) s
  JOIN (SELECT cast(o_orderkey AS string) AS order_game, o_orderdate, o_orderpriority FROM {orders}) o
    ON s.game_id = o.order_game
) counted
"""

_PLAYER_BOX = """
SELECT season, game_id, game_date, seq, team_id, athlete_id, athlete_name, position_raw, minutes, starter,
       did_not_play, 2 * fgm + fg3m + ftm AS pts, fgm, fga, fg3m, fg3a, ftm, fta, oreb, dreb,
       oreb + dreb AS reb, ast, stl, blk, tov, pf
FROM (
  SELECT cast(year(o.o_orderdate) AS int) AS season,
         cast(o.o_custkey AS string) AS game_id,
         cast(o.o_orderdate AS date) AS game_date,
         l.l_orderkey * 10 + l.l_linenumber AS seq,
         cast(2 * (o.o_custkey % 15) + l.l_suppkey % 2 AS string) AS team_id,
         cast(l.l_partkey AS string) AS athlete_id,
         concat('Player ', cast(l.l_partkey AS string)) AS athlete_name,
         CASE p.p_size % 7 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' WHEN 3 THEN 'G-F'
                           WHEN 4 THEN 'F-C' WHEN 5 THEN 'PG' ELSE NULL END AS position_raw,
         CASE WHEN l.l_returnflag = 'R' AND l.l_orderkey % 5 = 0 THEN 0e0 ELSE l.l_quantity END AS minutes,
         l.l_linenumber <= 2 AS starter,
         CASE WHEN l.l_orderkey % 29 = 0 THEN NULL ELSE l.l_orderkey % 23 = 0 END AS did_not_play,
         cast(floor(0.45e0 * ((l.l_partkey + l.l_linenumber) % 9)) AS double) AS fgm,
         cast((l.l_partkey + l.l_linenumber) % 9 AS double) AS fga,
         cast(floor(0.2e0 * ((l.l_partkey + l.l_linenumber) % 9)) AS double) AS fg3m,
         cast(floor(0.5e0 * ((l.l_partkey + l.l_linenumber) % 9)) AS double) AS fg3a,
         cast(floor(0.75e0 * (l.l_partkey % 5)) AS double) AS ftm,
         cast(l.l_partkey % 5 AS double) AS fta,
         cast(l.l_suppkey % 4 AS double) AS oreb,
         cast(l.l_orderkey % 6 AS double) AS dreb,
         cast((l.l_partkey + l.l_suppkey) % 7 AS double) AS ast,
         cast(l.l_linenumber % 3 AS double) AS stl,
         cast(l.l_partkey % 3 AS double) AS blk,
         cast((l.l_partkey + l.l_orderkey) % 4 AS double) AS tov,
         cast(l.l_suppkey % 6 AS double) AS pf
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
) stats
"""

_ROSTER = """
SELECT cast(p_partkey AS string) AS athlete_id,
       CASE p_size % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' WHEN 3 THEN 'G/F' ELSE NULL END AS position,
       p_name AS full_name,
       cast(p_size % 30 AS double) AS roster_gp,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE cast(p_size % 20 AS double) END AS roster_gs
FROM {part}
"""

_SCHEDULE = """
SELECT h.game_id, h.season, h.game_date, h.team_id AS home_id, a.team_id AS away_id,
       concat('T', h.team_id) AS home_abbreviation, concat('T', a.team_id) AS away_abbreviation,
       concat('Team ', h.team_id) AS home_display_name, concat('Team ', a.team_id) AS away_display_name,
       concat('c', cast(hs.region_no AS string)) AS home_conference_id,
       concat('c', cast(aw.region_no AS string)) AS away_conference_id,
       h.pts AS home_score, a.pts AS away_score,
       o.o_orderstatus <> 'O' AS status_type_completed,
       cast(CASE WHEN o.o_orderkey % 10 = 0 THEN 5 WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE 4 END AS int) AS status_period,
       o.o_orderkey % 11 = 0 AS neutral_site,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'Exhibition Classic' WHEN o.o_orderkey % 89 = 0 THEN 'Cup Final'
            WHEN o.o_orderkey % 3 = 0 THEN 'Regular night' ELSE NULL END AS notes_headline,
       concat('c', cast(hs.region_no AS string)) AS groups_id,
       concat('Conf ', hs.region_name) AS groups_short_name
FROM {team_box} h
JOIN {team_box} a ON h.game_id = a.game_id
JOIN {orders} o ON h.game_id = cast(o.o_orderkey AS string)
JOIN {team_region} hs ON h.team_id = hs.team_id
JOIN {team_region} aw ON a.team_id = aw.team_id
WHERE h.team_home_away = 'home' AND a.team_home_away = 'away' AND h.team_id <> a.team_id
"""

# A team's region is the smallest one of its suppliers.
_TEAM_REGION = """
SELECT t.team_id, t.region_no, r.r_name AS region_name
FROM (
  SELECT cast(s.s_suppkey % 360 AS string) AS team_id, min(n.n_regionkey) AS region_no
  FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1
) t JOIN {region} r ON t.region_no = r.r_regionkey
"""

_EVENT_ROWS = """
SELECT event_id, event_type, value, ts, g, rn, n, period_number, league,
       row_number() OVER (PARTITION BY g, period_number ORDER BY rn) AS k,
       count(*) OVER (PARTITION BY g, period_number) AS c,
       CASE WHEN league = 'mbb' AND period_number > 2 THEN 300 WHEN league = 'mbb' THEN 1200
            WHEN league = 'nba' THEN 720 ELSE 600 END AS plen,
       cast(floor(event_id / 2e0) AS bigint) AS m,
       g % 30 AS home_no,
       (g % 30 + 1 + cast(floor(g / 30e0) AS bigint) % 29) % 30 AS away_no,
       CASE WHEN event_id % 2 = 0 THEN g % 30
            ELSE (g % 30 + 1 + cast(floor(g / 30e0) AS bigint) % 29) % 30 END AS own_no
FROM (
  SELECT event_id, event_type, value, ts, g, rn, n,
         cast(floor(cast((rn - 1) * 4 AS double) / n) AS int) + 1 AS period_number,
         CASE g % 4 WHEN 0 THEN 'wnba' WHEN 1 THEN 'wbb' WHEN 2 THEN 'mbb' ELSE 'nba' END AS league
  FROM (
    SELECT event_id, event_type, value, ts, g,
           row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS rn,
           count(*) OVER (PARTITION BY g) AS n
    FROM (
      SELECT event_id, event_type, value, ts,
             cast(floor(event_id / 10000e0) AS bigint) * 150 + user_id % 150 AS g
      FROM {events}
    ) keyed
  ) ranked
) timed
"""

_EVENT_TEXT = """
SELECT r.*,
       cast(plen - floor(cast(k * plen AS double) / (c + 1)) AS bigint) AS secs,
       concat(cast(own_no * 100 + m % 10 AS string), '') AS actor,
       concat(cast(own_no * 100 + 5 + m % 5 AS string), '') AS bench,
       CASE event_type
         WHEN 'purchase' THEN CASE m % 4 WHEN 0 THEN 'JumpShot' WHEN 1 THEN 'LayUpShot' WHEN 2 THEN 'DunkShot' ELSE 'Hook Shot' END
         WHEN 'view' THEN CASE WHEN m % 6 = 0 THEN 'Block Shot' ELSE 'JumpShot' END
         WHEN 'click' THEN CASE WHEN m % 11 = 0 THEN 'Steal' WHEN m % 5 IN (0, 1) THEN 'Offensive Rebound'
                                WHEN m % 5 IN (2, 3) THEN 'Defensive Rebound' ELSE 'Dead Ball Rebound' END
         WHEN 'error' THEN CASE m % 5 WHEN 0 THEN 'Bad Pass Turnover' WHEN 1 THEN 'Traveling' WHEN 2 THEN 'Shot Clock Turnover'
                                WHEN 3 THEN 'Lost Ball Turnover' ELSE 'Personal Foul' END
         ELSE CASE WHEN m % 8 IN (4, 5, 6) THEN 'Substitution' WHEN m % 8 = 7 THEN NULL ELSE 'MadeFreeThrow' END
       END AS type_text,
       CASE event_type
         WHEN 'purchase' THEN concat(CASE WHEN m % 3 = 0 THEN 'makes Three Point jumper' WHEN m % 2 = 0 THEN 'made Layup' ELSE 'makes dunk' END,
                                     CASE WHEN m % 5 IN (0, 1) THEN ' (teammate assists)' ELSE '' END)
         WHEN 'view' THEN CASE WHEN m % 6 = 0 THEN 'blocks the attempt' WHEN m % 3 = 1 THEN 'misses three point jumper' ELSE 'misses layup' END
         WHEN 'click' THEN CASE WHEN m % 11 = 0 THEN 'steal' WHEN m % 5 IN (0, 1) THEN 'Offensive rebound'
                                WHEN m % 5 IN (2, 3) THEN 'Defensive rebound' ELSE 'dead ball team rebound' END
         WHEN 'error' THEN CASE m % 5 WHEN 0 THEN 'bad pass (opponent steals)' WHEN 1 THEN 'traveling' WHEN 2 THEN 'shot clock violation'
                                WHEN 3 THEN 'lost ball turnover' ELSE 'foul on the play' END
         ELSE CASE m % 8 WHEN 0 THEN 'makes free throw 1 of 2' WHEN 1 THEN 'makes free throw 2 of 2' WHEN 2 THEN 'misses free throw 2 of 2'
                         WHEN 3 THEN 'makes free throw' WHEN 4 THEN 'enters the game for' WHEN 5 THEN 'subbing in for team'
                         WHEN 6 THEN 'subbing out for team' ELSE 'makes technical Free Throw 1 of 1' END
       END AS text,
       event_type = 'purchase' OR (event_type = 'signup' AND m % 8 IN (0, 1, 3, 7)) AS scored,
       CASE WHEN event_type = 'purchase' THEN CASE WHEN m % 3 = 0 THEN 3 ELSE 2 END
            WHEN event_type = 'signup' AND m % 8 IN (0, 1, 3, 7) THEN 1 ELSE 0 END AS worth
FROM {event_rows} r
"""

_PBP = """
SELECT league, game_id, season, sequence_number, period_number, clock_display_value, team_id, type_text, text,
       scoring_play, score_value, athlete_id_1, athlete_id_2, coordinate_x, coordinate_y,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE home_run END AS home_score,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE away_run END AS away_score,
       home_team_id, away_team_id, home_team_abbrev, away_team_abbrev, game_date,
       CASE WHEN g % 37 = 0 THEN NULL ELSE home_end > away_end END AS home_team_winner
FROM (
  SELECT league, concat('g', cast(g AS string)) AS game_id, cast(2020 + g % 5 AS int) AS season, g, event_id,
         cast(rn AS double) AS sequence_number,
         CASE WHEN event_id % 499 = 0 THEN NULL ELSE period_number END AS period_number,
         CASE WHEN event_id % 211 = 0 THEN 'END'
              WHEN secs >= 60 THEN concat(cast(cast(floor(secs / 60e0) AS bigint) AS string), ':',
                                          lpad(cast(secs % 60 AS string), 2, '0'))
              ELSE concat(cast(secs AS string), '.', cast(event_id % 10 AS string)) END AS clock_display_value,
         CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 307 = 0 THEN '9999'
              ELSE cast(1000 + own_no AS string) END AS team_id,
         type_text, text, scored AS scoring_play,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE cast(worth AS double) END AS score_value,
         CASE WHEN type_text = 'Substitution' THEN bench ELSE actor END AS athlete_id_1,
         CASE WHEN type_text = 'Substitution' AND m % 8 = 4 THEN cast(own_no * 100 + m % 5 AS string) ELSE NULL END AS athlete_id_2,
         CASE WHEN m % 17 = 0 THEN NULL ELSE (value * 7) % 94e0 - 47 END AS coordinate_x,
         CASE WHEN m % 17 = 0 THEN NULL ELSE (value * 13) % 50e0 - 25 END AS coordinate_y,
         cast(sum(CASE WHEN own_no = home_no THEN worth ELSE 0 END) OVER (PARTITION BY g ORDER BY rn ROWS UNBOUNDED PRECEDING) AS int) AS home_run,
         cast(sum(CASE WHEN own_no = away_no THEN worth ELSE 0 END) OVER (PARTITION BY g ORDER BY rn ROWS UNBOUNDED PRECEDING) AS int) AS away_run,
         cast(sum(CASE WHEN own_no = home_no THEN worth ELSE 0 END) OVER (PARTITION BY g) AS int) AS home_end,
         cast(sum(CASE WHEN own_no = away_no THEN worth ELSE 0 END) OVER (PARTITION BY g) AS int) AS away_end,
         cast(1000 + home_no AS string) AS home_team_id, cast(1000 + away_no AS string) AS away_team_id,
         concat('T', lpad(cast(home_no AS string), 2, '0')) AS home_team_abbrev,
         concat('T', lpad(cast(away_no AS string), 2, '0')) AS away_team_abbrev,
         cast(min(ts) OVER (PARTITION BY g) AS date) AS game_date
  FROM {event_text}
) fields
"""

# @SLOTS is the one spot where the dialects differ: a select-list generator of 0..9.
_STARTERS = """
SELECT game_id, team_id, cast((cast(team_id AS bigint) - 1000) * 100 + j AS string) AS athlete_id,
       j < CASE WHEN g % 13 = 0 THEN 4 ELSE 5 END AS starter
FROM (
  SELECT game_id, g, team_id, @SLOTS AS j
  FROM (
    SELECT game_id, g, home_team_id AS team_id FROM {event_games}
    UNION ALL
    SELECT game_id, g, away_team_id AS team_id FROM {event_games}
  ) sides
) boxed
"""

_EVENT_GAMES = """
SELECT concat('g', cast(g AS string)) AS game_id, g,
       cast(1000 + g % 30 AS string) AS home_team_id,
       cast(1000 + (g % 30 + 1 + cast(floor(g / 30e0) AS bigint) % 29) % 30 AS string) AS away_team_id
FROM (SELECT DISTINCT cast(floor(event_id / 10000e0) AS bigint) * 150 + user_id % 150 AS g FROM {events}) games
"""

# The games of the event feed as a schedule: running scores only grow, so the last one is the largest.
_EVENT_SCHEDULE = """
SELECT league, season, game_id, min(game_date) AS game_date, home_team_abbrev AS home_abbreviation, away_team_abbrev AS away_abbreviation,
       cast(max(home_score) AS double) AS home_score, cast(max(away_score) AS double) AS away_score,
       max(period_number) AS status_period, true AS status_type_completed
FROM {pbp} GROUP BY league, season, game_id, home_team_abbrev, away_team_abbrev
"""

_LINEUP_POOL = """
SELECT concat('P', cast(slot AS string)) AS player, slot,
       CASE slot % 7 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' WHEN 3 THEN 'G-F' WHEN 4 THEN 'F-C' WHEN 5 THEN 'G' ELSE 'F' END AS position,
       CASE slot % 4 WHEN 0 THEN 'Veteran' WHEN 1 THEN 'Rookie' WHEN 2 THEN 'Reserve' ELSE NULL END AS contract_type,
       games_played,
       0.1e0 + (fga % 23) / 100e0 AS usage,
       (fgm + 0.5e0 * fg3m) / fga AS efg_pct,
       tov / (fga + 0.44e0 * fta + tov) AS tov_pct,
       oreb / (oreb + 10e0 * games_played) AS oreb_pct,
       fta / fga AS fta_rate
FROM (
  SELECT cast(team_id AS bigint) * 12 + cast(athlete_id AS bigint) % 12 AS slot,
         count(DISTINCT game_id) AS games_played,
         sum(fga) AS fga, sum(fgm) AS fgm, sum(fg3m) AS fg3m, sum(fta) AS fta, sum(tov) AS tov, sum(oreb) AS oreb
  FROM {player_box} GROUP BY 1
) totals
WHERE fga > 0
"""

# view -> (SQL text, inputs)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "team_sides": (_TEAM_SIDES, ["lineitem"]),
    "team_box": (_TEAM_BOX, ["team_sides", "orders"]),
    "player_box": (_PLAYER_BOX, ["lineitem", "orders", "part"]),
    "roster": (_ROSTER, ["part"]),
    "team_region": (_TEAM_REGION, ["supplier", "nation", "region"]),
    "schedule": (_SCHEDULE, ["team_box", "orders", "team_region"]),
    "event_rows": (_EVENT_ROWS, ["events"]),
    "event_text": (_EVENT_TEXT, ["event_rows"]),
    "pbp": (_PBP, ["event_text"]),
    "event_schedule": (_EVENT_SCHEDULE, ["pbp"]),
    "event_games": (_EVENT_GAMES, ["events"]),
    "starters": (_STARTERS, ["event_games"]),
    "lineup_pool": (_LINEUP_POOL, ["player_box"]),
}


# view -> (input, key): the key its windows start from, by which the input is dealt before
DEALT = {"event_rows": ("events", "cast(floor(event_id / 10000e0) AS bigint) * 150 + user_id % 150")}

# view -> (view, input): the same rows, joined to that input by an exchange on its key, so that rows of one key leave together
TOGETHER = {"player_box_by_player": ("player_box", "part")}


def _order(names: Iterable[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in seen:
            for dep in VIEWS[name][1]:
                visit(dep)
            seen.append(name)

    for n in names:
        visit(n)
    return seen


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the parquet tables of a folder (lazy)."""
    name, exchanged = TOGETHER.get(name, (name, None))
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, deps = VIEWS[name]
    text = text.replace("@SLOTS", "explode(sequence(0, 9))")
    frames = {d: load_view(spark, sf_dir, d) for d in deps}
    if name in DEALT:
        dep, key = DEALT[name]
        frames[dep] = spread(frames[dep], F.expr(key))
    if exchanged:
        frames[exchanged] = frames[exchanged].hint("merge")
    return spark.sql(text, **frames)


def view_ctes(*names: str) -> str:
    """`name AS (...)` list for the named views and what they read, in dependency order."""
    parts = []
    for n in _order(names):
        text, deps = VIEWS[n]
        text = text.replace("@SLOTS", "unnest(generate_series(0, 9))")
        parts.append(f"{n} AS ({text.format(**{d: d for d in deps})})")
    return ",\n".join(parts)
