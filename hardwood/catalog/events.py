"""Play-by-play queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.registry import query
from hardwood.functions.clock import clock_to_seconds, period_seconds, round_half_even, seconds_left_in_game, seconds_to_clock
from hardwood.functions.geometry import in_paint, shot_distance, shot_zone
from hardwood.functions.text import free_throw_count
from hardwood.operators import events as E
from hardwood.plans import fill
from hardwood.plans import possessions as P
from hardwood.plans import stints as S
from hardwood.session import materialize, scratch_folder

_RX = {
    "ft": "free throw", "reb": "rebound", "oreb": "offensive rebound", "stl": "steal",
    "tov": "turnover|traveling|double dribble|palming|backcourt|shot clock", "shotw": "shot|jumper|layup|dunk",
    "deadb": "dead ball", "deadr": "dead ?ball|team rebound", "foulw": "foul", "prof": "rebound|free throw|block",
}

ORDERED = """, o AS (SELECT *, CASE WHEN contains(clock_display_value, ':')
     THEN try_cast(split_part(clock_display_value, ':', 1) AS double) * 60 + try_cast(split_part(clock_display_value, ':', 2) AS double)
     ELSE try_cast(clock_display_value AS double) END AS raw, concat(coalesce(type_text, ''), ' ', coalesce(text, '')) AS blob FROM pbp),
 ord AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period_number NULLS LAST, raw DESC NULLS LAST, sequence_number) AS idx,
     round_even(raw, 0) AS secs, """ + ", ".join(f"regexp_matches(blob, '{p}', 'i') AS w_{k}" for k, p in _RX.items()) + """ FROM o),
 fl AS (SELECT *, w_ft AS ft, w_reb AS reb, w_oreb AS oreb, w_stl AS stl, w_tov AS tov, coalesce(scoring_play, false) AS made,
     coalesce(regexp_matches(text, 'three point|3-point', 'i'), false) OR coalesce(score_value = 3, false) AS is_three,
     w_reb AND NOT w_oreb AND NOT w_deadb AS dreb, w_shotw AND NOT w_reb AND NOT w_ft AS shot, w_shotw AND NOT w_prof AS profile_shot,
     coalesce(regexp_matches(text, 'assist', 'i'), false) AS assisted, w_foulw AND NOT w_ft AS foul,
     (w_shotw OR (w_reb AND NOT w_deadr) OR w_tov) AND NOT w_ft AS live,
     (w_shotw AND NOT w_reb AND NOT w_ft) OR w_reb OR w_tov OR w_ft AS ball,
     try_cast(nullif(regexp_extract(lower(text), 'free throw\\s+(\\d+)\\s+of\\s+(\\d+)', 1), '') AS int) AS ft_k,
     try_cast(nullif(regexp_extract(lower(text), 'free throw\\s+(\\d+)\\s+of\\s+(\\d+)', 2), '') AS int) AS ft_n FROM ord),
 nx AS (SELECT f.*, (SELECT min(b.idx) FROM fl b WHERE b.game_id = f.game_id AND b.idx > f.idx AND b.ball) AS nidx FROM fl f),
 ev AS (SELECT f.*, f.ft AND CASE WHEN f.ft_k IS NOT NULL AND f.ft_n IS NOT NULL THEN f.ft_k = f.ft_n
              ELSE NOT coalesce(n.ft AND n.team_id = f.team_id, false) END AS last_ft,
         f.stl OR coalesce(lag(f.stl) OVER g, false) OR coalesce(lead(f.stl) OVER g, false) AS stl_near,
         coalesce(last_value(f.home_score IGNORE NULLS) OVER g, first_value(f.home_score IGNORE NULLS) OVER (PARTITION BY f.game_id ORDER BY f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS home_fill,
         coalesce(last_value(f.away_score IGNORE NULLS) OVER g, first_value(f.away_score IGNORE NULLS) OVER (PARTITION BY f.game_id ORDER BY f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS away_fill
       FROM nx f LEFT JOIN fl n ON n.game_id = f.game_id AND n.idx = f.nidx
       WINDOW g AS (PARTITION BY f.game_id ORDER BY f.idx ROWS UNBOUNDED PRECEDING))"""

# A step-by-step walk as a recursive query: one event of every game per step.
WALK = ORDERED + """, wk AS (
 WITH RECURSIVE w AS (
  SELECT DISTINCT game_id, 0::bigint AS idx, NULL::int AS per, NULL::varchar AS off, 0 AS pid, '' AS owed,
         false AS opens, false AS act, NULL::varchar AS off1, NULL::varchar AS reason, 0 AS pid0, '' AS owed0 FROM ev
  UNION ALL
  SELECT game_id, idx, coalesce(p, per) AS per,
         CASE WHEN reason IS NULL THEN off1 WHEN reason = 'dreb' THEN t WHEN t = h THEN a ELSE h END AS off,
         pid0 + CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS pid,
         CASE WHEN reason = 'made_fg' THEN t WHEN act AND (shot OR reb OR tov) THEN '' ELSE owed0 END AS owed,
         opens, act, off1, reason, pid0, owed0
  FROM (SELECT *, CASE WHEN NOT act OR oreb THEN NULL WHEN dreb THEN CASE WHEN t <> off1 THEN 'dreb' END WHEN tov THEN 'turnover'
                       WHEN made AND NOT ft THEN 'made_fg' WHEN made AND last_ft AND t = off1 THEN 'made_ft' END AS reason
        FROM (SELECT *, CASE WHEN opens THEN t ELSE off0 END AS off1
              FROM (SELECT *, side AND off0 IS NULL AND ball AS opens, side AND (off0 IS NOT NULL OR ball) AS act
                    FROM (SELECT e.game_id, e.idx, e.period_number AS p, e.team_id AS t, e.home_team_id AS h, e.away_team_id AS a,
                                 e.ball, e.ft, e.reb, e.oreb, e.dreb, e.tov, e.shot, e.made, e.last_ft, w.per, w.owed AS owed0,
                                 coalesce(e.team_id IN (e.home_team_id, e.away_team_id), false) AND e.period_number IS NOT NULL AS side,
                                 CASE WHEN w.per IS NOT NULL AND e.period_number IS NOT NULL AND e.period_number <> w.per THEN NULL ELSE w.off END AS off0,
                                 w.pid + CASE WHEN w.per IS NOT NULL AND e.period_number IS NOT NULL AND e.period_number <> w.per AND w.off IS NOT NULL THEN 1 ELSE 0 END AS pid0
                          FROM w JOIN ev e ON e.game_id = w.game_id AND e.idx = w.idx + 1) s1) s2) s3) s4)
 SELECT * FROM w WHERE idx > 0),
 st AS (SELECT e.*, wk.opens, wk.act, wk.off1, wk.reason, wk.pid0, wk.owed0,
          CASE WHEN e.score_value > 0 THEN e.score_value WHEN e.ft THEN 1 ELSE 2 END AS worth,
          lag(e.home_fill) OVER g AS hprev, lag(e.away_fill) OVER g AS aprev,
          CASE WHEN e.team_id = e.home_team_id THEN e.away_team_id ELSE e.home_team_id END AS oth
        FROM ev e JOIN wk ON e.game_id = wk.game_id AND e.idx = wk.idx WINDOW g AS (PARTITION BY e.game_id ORDER BY e.idx)),
 op AS (SELECT game_id, pid0 + 1 AS poss_id, period_number, 'period_start' AS start_reason, team_id AS off, secs AS s, idx AS start_idx,
          CASE WHEN idx <= 1 THEN 0 ELSE hprev END AS hs, CASE WHEN idx <= 1 THEN 0 ELSE aprev END AS aws FROM st WHERE opens
        UNION ALL
        SELECT game_id, pid0 + 2, period_number, CASE WHEN reason = 'turnover' AND stl_near THEN 'steal' ELSE reason END,
          CASE WHEN reason = 'dreb' THEN team_id ELSE oth END, secs, idx, home_fill, away_fill FROM st WHERE reason IS NOT NULL),
 cl AS (SELECT game_id, pid0 + 1 AS poss_id, reason AS end_reason, secs AS e, idx AS end_idx FROM st WHERE reason IS NOT NULL),
 ad AS (SELECT game_id, CASE WHEN team_id = off1 THEN pid0 + 1 ELSE pid0 END AS poss_id, sum(worth) AS pts FROM st
        WHERE act AND made AND (team_id = off1 OR (ft AND team_id = owed0 AND pid0 > 0)) GROUP BY 1, 2),
 ins AS (SELECT game_id, pid0 + 1 AS poss_id, max(CASE WHEN shot THEN secs END) AS shot_s, bool_or(oreb) AS had_oreb FROM st
        WHERE act AND team_id = off1 GROUP BY 1, 2),
 pe AS (SELECT game_id, period_number, max(idx) AS last_idx FROM ev WHERE period_number IS NOT NULL GROUP BY 1, 2),
 gm AS (SELECT game_id, max(period_number) AS last_p, max(idx) AS n, min(league) AS league, min(home_team_id) AS h, min(home_team_abbrev) AS ha,
          min(away_team_abbrev) AS aa FROM ev GROUP BY 1),
 po AS (SELECT op.game_id, gm.league, op.period_number AS period, op.poss_id, CASE WHEN op.off = gm.h THEN gm.ha ELSE gm.aa END AS off_team,
          CASE WHEN op.off = gm.h THEN gm.aa ELSE gm.ha END AS def_team, op.s, CASE WHEN cl.poss_id IS NULL THEN 0 ELSE coalesce(cl.e, op.s) END AS e,
          cast(coalesce(ad.pts, 0) AS int) AS points,
          CASE WHEN ins.had_oreb THEN 'second_chance' WHEN op.start_reason IN ('dreb', 'steal', 'made_fg', 'made_ft') AND op.s - ins.shot_s <= 7
               THEN 'transition' ELSE 'halfcourt' END AS context,
          op.start_reason, coalesce(cl.end_reason, 'period_end') AS end_reason, coalesce(ins.had_oreb, false) AS had_oreb, op.start_idx,
          coalesce(cl.end_idx, CASE WHEN op.period_number = gm.last_p THEN gm.n ELSE pe.last_idx END) AS end_idx,
          op.off = gm.h AS off_is_home, op.hs, op.aws
        FROM op JOIN gm ON op.game_id = gm.game_id JOIN pe ON pe.game_id = op.game_id AND pe.period_number = op.period_number
        LEFT JOIN cl ON cl.game_id = op.game_id AND cl.poss_id = op.poss_id LEFT JOIN ad ON ad.game_id = op.game_id AND ad.poss_id = op.poss_id
        LEFT JOIN ins ON ins.game_id = op.game_id AND ins.poss_id = op.poss_id)"""


def clock_sql(s: str) -> str:
    return f"concat(cast(floor({s} / 60) AS int), ':', lpad(cast(cast({s} AS int) % 60 AS varchar), 2, '0'))"


def left_sql(league: str, period: str, s: str) -> str:
    return (
        f"CASE WHEN {period} IS NULL THEN NULL WHEN {league} = 'mbb' AND {period} <= 2 THEN {s} + (2 - {period}) * 1200 WHEN {league} = 'mbb' THEN {s} "
        f"WHEN {period} > 4 THEN {s} WHEN {league} = 'nba' THEN {s} + (4 - {period}) * 720 ELSE {s} + (4 - {period}) * 600 END"
    )


@query(
    "clock_parse", ("pbp",),
    ORDERED + f""" SELECT game_id, cast(sequence_number AS bigint) AS seq, secs, CASE WHEN secs IS NOT NULL THEN {clock_sql('secs')} END AS clock,
      cast({left_sql('league', 'period_number', 'secs')} AS int) AS left_game,
      CASE WHEN period_number IS NULL THEN NULL WHEN league = 'mbb' AND period_number > 2 THEN 300 WHEN league = 'mbb' THEN 1200 WHEN league = 'nba' THEN 720 ELSE 600 END AS period_len FROM ord""",
)
def clock_parse(t):
    s = round_half_even(clock_to_seconds("clock_display_value"))
    return t.pbp.withColumn("secs", s).select(
        "game_id", F.col("sequence_number").cast("bigint").alias("seq"), "secs", seconds_to_clock("secs").alias("clock"),
        seconds_left_in_game("league", "period_number", "secs").cast("int").alias("left_game"),
        period_seconds("league", "period_number").alias("period_len"),
    )


_FLAGS = ["ft", "reb", "oreb", "dreb", "stl", "tov", "shot", "profile_shot", "ball", "made", "is_three", "assisted", "foul", "live"]


@query("event_flags", ("pbp",), ORDERED + f" SELECT game_id, idx, {', '.join(_FLAGS)}, ft_k, ft_n FROM fl")
def event_flags(t):
    k, n = free_throw_count("text")
    return E.event_flags(E.order_events(t.pbp)).select("game_id", "idx", *_FLAGS, k.alias("ft_k"), n.alias("ft_n"))


@query(
    "shot_zones", ("pbp",),
    ORDERED + """, d AS (SELECT game_id, idx, is_three, coordinate_x AS x, coordinate_y AS y, least(sqrt(pow(coordinate_x - 41.75e0, 2) + coordinate_y * coordinate_y),
         sqrt(pow(coordinate_x + 41.75e0, 2) + coordinate_y * coordinate_y)) AS distance FROM fl WHERE profile_shot)
      SELECT game_id, idx, round(distance, 6) AS distance, abs(y) <= 6 AND abs(x) >= 28 AS in_paint,
        CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN is_three AND abs(y) >= 21 AND abs(x) >= 34 THEN 'corner_3' WHEN is_three THEN 'above_break_3'
             WHEN distance <= 4 THEN 'at_rim' WHEN abs(y) <= 6 AND abs(x) >= 28 THEN 'paint' ELSE 'mid_range' END AS zone FROM d""",
)
def shot_zones(t):
    x, y = "coordinate_x", "coordinate_y"
    return E.event_flags(E.order_events(t.pbp)).where("profile_shot").select(
        "game_id", "idx", F.round(shot_distance(x, y), 6).alias("distance"), in_paint(x, y).alias("in_paint"),
        shot_zone(x, y, "is_three").alias("zone"),
    )


@query("last_ft", ("pbp",), ORDERED + " SELECT game_id, idx, last_ft, stl_near FROM ev WHERE ft OR stl_near")
def last_ft(t):
    ev = E.steal_nearby(E.last_free_throw(E.event_flags(E.order_events(t.pbp))))
    return ev.where("ft OR stl_near").select("game_id", "idx", "last_ft", "stl_near")


@query("score_ffill", ("pbp",), ORDERED + " SELECT game_id, idx, home_fill, away_fill FROM ev")
def score_ffill(t):
    return P.prepared_events(t.pbp).select("game_id", "idx", "home_fill", "away_fill")


TRIPS = """, ct AS (SELECT *, sum(live::int) OVER g AS nl, sum(foul::int) OVER g AS nf FROM ev WINDOW g AS (PARTITION BY game_id ORDER BY idx)),
 fr AS (SELECT *, CASE WHEN lag(idx) OVER g IS NULL OR nl > lag(nl) OVER g OR nf > lag(nf) OVER g OR team_id IS NULL OR lag(team_id) OVER g IS NULL
     OR team_id <> lag(team_id) OVER g OR coalesce(athlete_id_1 <> lag(athlete_id_1) OVER g, false) THEN 1 ELSE 0 END AS fresh
   FROM ct WHERE ft WINDOW g AS (PARTITION BY game_id ORDER BY idx)),
 ftr AS (SELECT *, sum(fresh) OVER (PARTITION BY game_id ORDER BY idx) AS trip_id FROM fr),
 trips AS (SELECT *, row_number() OVER (PARTITION BY game_id, trip_id ORDER BY idx) AS shot_num, count(*) OVER (PARTITION BY game_id, trip_id) AS trip_size FROM ftr)"""


@query(
    "ft_trips", ("pbp",),
    ORDERED + TRIPS + " SELECT game_id, idx, cast(trip_id AS int) AS trip_id, shot_num, trip_size, ft_k AS txt_shot, ft_n AS txt_of FROM trips",
)
def ft_trips(t):
    return E.free_throw_trips(P.prepared_events(t.pbp)).select(
        "game_id", "idx", "trip_id", "shot_num", "trip_size", "txt_shot", "txt_of"
    )


@query(
    "ft_trip_agreement", ("pbp",),
    ORDERED + TRIPS + " SELECT count(*) AS stated, avg(CASE WHEN shot_num = ft_k AND trip_size = ft_n THEN 1e0 ELSE 0e0 END) AS agreement FROM trips WHERE ft_k IS NOT NULL",
)
def ft_trip_agreement(t):
    return E.trip_agreement(E.free_throw_trips(P.prepared_events(t.pbp)))


SUBS = ORDERED + """, sb AS (SELECT *, coalesce(regexp_matches(type_text, 'substitution', 'i'), false) OR coalesce(regexp_matches(text, 'subbing (in|out)|enters', 'i'), false) AS is_sub FROM fl),
 sd AS (SELECT *, CASE WHEN NOT is_sub THEN NULL WHEN athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL THEN 'paired'
     WHEN regexp_matches(text, 'subbing out|leaves|checks out', 'i') THEN 'out' WHEN regexp_matches(text, 'subbing in|enters|checks in', 'i') THEN 'in' END AS sub_dir,
     CASE WHEN is_sub THEN concat(coalesce(cast(period_number AS varchar), 'NA'), ' ', coalesce(cast(secs AS varchar), 'NA')) END AS skey FROM sb),
 sg AS (SELECT *, is_sub AND (coalesce(sub_dir = 'paired', false) OR lag(skey) OVER g IS DISTINCT FROM skey OR coalesce(lag(sub_dir) OVER g = 'paired', false)) AS grp_start,
     is_sub AND (coalesce(sub_dir = 'paired', false) OR lead(skey) OVER g IS DISTINCT FROM skey OR coalesce(lead(sub_dir) OVER g = 'paired', false)) AS grp_end
   FROM sd WINDOW g AS (PARTITION BY game_id ORDER BY idx))"""


@query("sub_groups", ("pbp",), SUBS + " SELECT game_id, idx, sub_dir, grp_start, grp_end FROM sg WHERE is_sub")
def sub_groups(t):
    return E.substitution_groups(E.event_flags(E.order_events(t.pbp))).where("is_sub").select(
        "game_id", "idx", "sub_dir", "grp_start", "grp_end"
    )


@query(
    "possessions", ("pbp",),
    WALK + f""" SELECT game_id, period, poss_id, off_team, def_team, CASE WHEN s IS NOT NULL THEN {clock_sql('s')} END AS clock_start,
      CASE WHEN e IS NOT NULL THEN {clock_sql('e')} END AS clock_end, CASE WHEN s - e < 0 THEN 0 ELSE s - e END AS seconds, points, context,
      start_reason, end_reason, had_oreb, start_idx, end_idx FROM po""",
)
def possessions(t):
    return P.possessions(t.pbp)


@query(
    "uncredited_points", ("pbp",),
    WALK + """ SELECT game_id, sum(CASE WHEN act AND made AND team_id <> off1 AND NOT (ft AND team_id = owed0 AND pid0 > 0) THEN worth ELSE 0 END) AS uncredited
      FROM st GROUP BY game_id""",
)
def uncredited_points(t):
    return P.uncredited_points(t.pbp)


STATES = WALK + TRIPS + f""", pure AS (SELECT game_id, poss_id, period, period > CASE WHEN league = 'mbb' THEN 2 ELSE 4 END AS is_ot, cast(s AS int) AS secs_left_period,
      cast({left_sql('league', 'period', 's')} AS int) AS secs_left_game, 'possession' AS state_type,
      CASE start_reason WHEN 'period_start' THEN 'period_start' ELSE concat('after_', start_reason) END AS state, true AS is_pure, off_team AS ball_team,
      off_is_home AS ball_is_home, hs AS home_score, aws AS away_score, hs - aws AS home_margin, CASE WHEN off_is_home THEN hs - aws ELSE aws - hs END AS ball_margin,
      NULL::int AS ft_shot_num, NULL::int AS ft_trip_size, NULL::int AS ft_shots_remaining, start_idx AS idx FROM po),
 un AS (SELECT game_id, max(CASE WHEN team_id NOT IN (home_team_id, away_team_id) THEN team_id END) AS odd, max(CASE WHEN team_id IN (home_team_id, away_team_id) THEN team_id END) AS one,
      count(DISTINCT CASE WHEN team_id NOT IN (home_team_id, away_team_id) THEN team_id END) AS n_odd, count(DISTINCT CASE WHEN team_id IN (home_team_id, away_team_id) THEN team_id END) AS n_one
      FROM ev GROUP BY game_id),
 tm AS (SELECT t.*, CASE WHEN t.team_id = t.home_team_id THEN t.home_team_abbrev WHEN t.team_id = t.away_team_id THEN t.away_team_abbrev
      WHEN n_odd = 1 AND n_one = 1 AND t.team_id = odd THEN CASE WHEN one = t.home_team_id THEN t.away_team_abbrev ELSE t.home_team_abbrev END END AS ab,
      coalesce(s.hprev, 0) AS hp, coalesce(s.aprev, 0) AS ap
      FROM trips t JOIN un ON t.game_id = un.game_id JOIN st s ON s.game_id = t.game_id AND s.idx = t.idx),
 fts AS (SELECT tm.game_id, (SELECT min(po.poss_id) FROM po WHERE po.game_id = tm.game_id AND tm.idx BETWEEN po.start_idx AND po.end_idx) AS poss_id,
      period_number AS period, period_number > CASE WHEN league = 'mbb' THEN 2 ELSE 4 END AS is_ot, cast(secs AS int) AS secs_left_period,
      cast({left_sql('league', 'period_number', 'secs')} AS int) AS secs_left_game, 'free_throw' AS state_type,
      concat('ft_', shot_num, '_of_', trip_size) AS state, false AS is_pure, ab AS ball_team, ab = home_team_abbrev AS ball_is_home, hp AS home_score, ap AS away_score,
      hp - ap AS home_margin, CASE WHEN ab = home_team_abbrev THEN hp - ap ELSE ap - hp END AS ball_margin, shot_num AS ft_shot_num, trip_size AS ft_trip_size,
      trip_size - shot_num + 1 AS ft_shots_remaining, idx FROM tm),
 states AS (SELECT * FROM pure UNION ALL SELECT * FROM fts)"""


@query("game_states", ("pbp",), STATES + " SELECT * FROM states")
def game_states(t):
    return P.game_states(P.possession_rows(P.prepared_events(t.pbp)))


# Step-by-step walk of the floor: one event of every game per step, lineups as lists.
FLOOR = SUBS + """, su AS (SELECT * FROM sg WHERE period_number IS NOT NULL),
 sq AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY idx) AS k,
     coalesce(team_id IN (home_team_id, away_team_id), false) AND is_sub AND sub_dir IS NOT NULL AS moves,
     CASE WHEN league = 'mbb' AND period_number > 2 THEN 300e0 WHEN league = 'mbb' THEN 1200e0 WHEN period_number > 4 THEN 300e0 WHEN league = 'nba' THEN 720e0 ELSE 600e0 END AS plen
   FROM su),
 g0 AS (SELECT s.game_id, list(CASE WHEN st.team_id = s.h THEN st.athlete_id END) FILTER (WHERE st.starter AND st.team_id = s.h) AS fh,
     list(st.athlete_id) FILTER (WHERE st.starter AND st.team_id = s.a) AS fa
   FROM (SELECT game_id, min(home_team_id) AS h, min(away_team_id) AS a FROM sq GROUP BY 1) s JOIN starters st ON st.game_id = s.game_id GROUP BY 1),
 fw AS (WITH RECURSIVE w AS (
   SELECT game_id, 0::bigint AS k, NULL::int AS per, NULL::double AS start_s, fh, fa, 0 AS no, false AS e1, NULL::double AS s1, NULL::int AS p1,
          false AS e2, NULL::double AS s2, NULL::double AS x2, NULL::int AS no_pts, fh AS bh, fa AS ba, false AS live FROM g0
   UNION ALL
   SELECT game_id, k, p, CASE WHEN grp_end THEN secs WHEN grp_start THEN NULL ELSE st0 END,
     CASE WHEN moves AND team_id = home_team_id THEN nf ELSE fh END, CASE WHEN moves AND team_id = away_team_id THEN nf ELSE fa END,
     no0 + grp_start::int, newp AND live0, prev_s, prev_p, grp_start, st0, secs, no0 + 1, fh, fa, grp_end OR NOT grp_start
   FROM (SELECT *, CASE sub_dir WHEN 'in' THEN list_distinct(list_append(f, athlete_id_1)) WHEN 'out' THEN list_filter(f, lambda x: x <> athlete_id_1)
                   ELSE list_distinct(list_append(list_filter(f, lambda x: x <> athlete_id_2), athlete_id_1)) END AS nf
     FROM (SELECT w.game_id, q.k, q.period_number AS p, q.secs, q.grp_start, q.grp_end, q.moves, q.team_id, q.home_team_id, q.away_team_id, q.sub_dir,
             q.athlete_id_1, q.athlete_id_2, w.fh, w.fa, w.per IS DISTINCT FROM q.period_number AS newp, w.live AND w.per IS NOT NULL AS live0,
             w.start_s AS prev_s, w.per AS prev_p, w.no + (w.per IS DISTINCT FROM q.period_number AND w.live AND w.per IS NOT NULL)::int AS no0,
             CASE WHEN w.per IS DISTINCT FROM q.period_number THEN q.plen ELSE w.start_s END AS st0,
             coalesce(CASE WHEN q.team_id = q.home_team_id THEN w.fh ELSE w.fa END, []) AS f
           FROM w JOIN sq q ON q.game_id = w.game_id AND q.k = w.k + 1) z) y)
  SELECT * FROM w WHERE k > 0),
 fin AS (SELECT game_id, max(k) AS k FROM fw GROUP BY 1),
 spn AS (SELECT game_id, no_pts - 1 AS stint_id, p1 AS period, s1 AS s, 0e0 AS e, bh, ba FROM fw WHERE e1
   UNION ALL SELECT game_id, no_pts, per, s2, coalesce(x2, s2), bh, ba FROM fw WHERE e2
   UNION ALL SELECT f.game_id, f.no + 1, f.per, f.start_s, 0e0, f.fh, f.fa FROM fw f JOIN fin ON fin.game_id = f.game_id AND fin.k = f.k),
 pts AS (SELECT q.game_id, f.no_pts AS stint_id, sum(CASE WHEN q.team_id = q.home_team_id THEN v END) AS hp, sum(CASE WHEN q.team_id = q.away_team_id THEN v END) AS ap
   FROM (SELECT *, CASE WHEN score_value > 0 THEN score_value WHEN regexp_matches(text, 'three', 'i') THEN 3 WHEN regexp_matches(text, 'free throw', 'i') THEN 1 ELSE 2 END AS v
         FROM sq WHERE NOT is_sub AND team_id IN (home_team_id, away_team_id) AND (made OR coalesce(regexp_matches(text, 'makes', 'i'), false))) q
   JOIN fw f ON f.game_id = q.game_id AND f.k = q.k GROUP BY 1, 2),
 bad AS (SELECT game_id FROM sq GROUP BY 1 HAVING sum((is_sub AND NOT moves)::int) > 0.1e0 * sum(is_sub::int)),
 gi AS (SELECT game_id, min(home_team_abbrev) AS ha, min(away_team_abbrev) AS aa, min(game_date) AS date FROM sq GROUP BY 1),
 two AS (SELECT spn.*, ha AS team, aa AS opponent, date, list_sort(list_distinct(bh)) AS five, coalesce(hp, 0) AS tp, coalesce(ap, 0) AS op
     FROM spn JOIN gi ON gi.game_id = spn.game_id LEFT JOIN pts ON pts.game_id = spn.game_id AND pts.stint_id = spn.stint_id
   UNION ALL SELECT spn.*, aa, ha, date, list_sort(list_distinct(ba)), coalesce(ap, 0), coalesce(hp, 0)
     FROM spn JOIN gi ON gi.game_id = spn.game_id LEFT JOIN pts ON pts.game_id = spn.game_id AND pts.stint_id = spn.stint_id),
 stints AS (SELECT game_id, team, opponent, date, stint_id, period, """ + f"CASE WHEN s IS NOT NULL THEN {clock_sql('s')} END AS clock_start, CASE WHEN e IS NOT NULL THEN {clock_sql('e')} END AS clock_end" + """,
   five[1] AS player_id_1, five[2] AS player_id_2, five[3] AS player_id_3, five[4] AS player_id_4, five[5] AS player_id_5,
   cast(tp AS int) AS team_pts, cast(op AS int) AS opp_pts, CASE WHEN s - e < 0 THEN 0 ELSE s - e END AS stint_seconds, coalesce(len(five), 0) = 5 AS lineup_valid
   FROM two WHERE game_id NOT IN (SELECT game_id FROM bad))"""


@query("stints", ("pbp", "starters"), FLOOR + " SELECT * FROM stints")
def stints(t):
    return S.lineup_stints(t.pbp, t.starters)


@query(
    "stint_report", ("pbp",),
    SUBS + """ SELECT game_id, cast(sum(is_sub::int) AS bigint) AS n_subs,
      cast(sum((is_sub AND (sub_dir IS NULL OR NOT coalesce(team_id IN (home_team_id, away_team_id), false)))::int) AS bigint) AS n_unresolved,
      sum((is_sub AND (sub_dir IS NULL OR NOT coalesce(team_id IN (home_team_id, away_team_id), false)))::int) > 0.1e0 * sum(is_sub::int) AS failed
      FROM sg WHERE period_number IS NOT NULL GROUP BY game_id""",
)
def stint_report(t):
    return S.stint_report(t.pbp, t.starters).select("game_id", "n_subs", "n_unresolved", "failed")


@query(
    "team_stints", ("pbp", "starters"),
    FLOOR + " SELECT *, team_pts - opp_pts AS plus_minus FROM stints WHERE stint_seconds >= 10",
)
def team_stints(t):
    return S.team_stints(S.lineup_stints(t.pbp, t.starters), min_seconds=10)


POPULATION = ("T03", "T07", "T11", "T19")
# The games of a population, home games first; and one game a team that the feed doesn't have.
_WANTED = WALK + FLOOR.removeprefix(ORDERED) + f""", wanted AS (SELECT game_id, CASE WHEN home_abbreviation IN {POPULATION} THEN 1 ELSE 2 END AS run FROM event_schedule
     WHERE home_abbreviation IN {POPULATION} OR away_abbreviation IN {POPULATION} UNION ALL SELECT concat('unplayed-', t), 2 FROM (SELECT unnest({list(POPULATION)}) AS t) u),
  led AS (SELECT w.game_id, 'stints' AS table_name, n_rows, CASE WHEN gm.game_id IS NULL THEN 'no events' WHEN w.game_id IN (SELECT game_id FROM bad) THEN 'unresolved substitutions'
        WHEN n_rows IS NULL THEN 'no rows' END AS reason, run FROM wanted w LEFT JOIN gm ON gm.game_id = w.game_id LEFT JOIN (SELECT game_id, count(*) AS n_rows FROM stints GROUP BY 1) n ON n.game_id = w.game_id
    UNION ALL SELECT w.game_id, 'possessions', n_rows, CASE WHEN gm.game_id IS NULL THEN 'no events' WHEN n_rows IS NULL THEN 'no rows' END, run
      FROM wanted w LEFT JOIN gm ON gm.game_id = w.game_id LEFT JOIN (SELECT game_id, count(*) AS n_rows FROM po GROUP BY 1) n ON n.game_id = w.game_id)"""


def _wanted(t):
    """All wanted games, and those of the first run."""
    pop = list(POPULATION)
    home, away = F.col("home_abbreviation").isin(pop), F.col("away_abbreviation").isin(pop)
    games = t.event_schedule.where(home | away).select("game_id", home.alias("at_home"))
    lost = t.spark.createDataFrame([(f"unplayed-{x}", False) for x in pop], "game_id string, at_home boolean")
    every = materialize(games.unionByName(lost))
    return every, every.where("at_home")


def _filled(t):
    folder = scratch_folder(t.spark, "fill")
    every, first = _wanted(t)
    fill.fill(t.pbp, t.starters, first, folder)
    fill.fill(t.pbp, t.starters, every, folder)
    if not fill.fill(t.pbp, t.starters, every, folder).isEmpty():
        raise RuntimeError("a run over settled games has nothing to do")
    return folder, every


@query(
    "population_fill", ("pbp", "event_schedule", "starters"),
    _WANTED + " SELECT game_id, table_name, reason IS NULL AS ok, reason, coalesce(n_rows, 0) AS n_rows, run FROM led",
)
def population_fill(t):
    """The ledger after two runs, of which the second takes up what the first left, and a third that finds nothing to do."""
    return fill.ledger(t.spark, _filled(t)[0])


@query(
    "population_fill_report", ("pbp", "event_schedule", "starters"),
    _WANTED + """ SELECT table_name, count(*) AS requested, count(*) FILTER (reason IS NULL) AS stored, count(reason) AS failed, 0 AS missing, cast(sum(coalesce(n_rows, 0)) AS bigint) AS n_rows
      FROM led GROUP BY 1""",
)
def population_fill_report(t):
    folder, every = _filled(t)
    return fill.fill_report(fill.ledger(t.spark, folder), every)


@query(
    "population_stored_stints", ("pbp", "event_schedule", "starters"),
    _WANTED + " SELECT * FROM stints WHERE game_id IN (SELECT game_id FROM wanted)",
)
def population_stored_stints(t):
    """What a reader of the filled folder gets."""
    return fill.stored_rows(t.spark, _filled(t)[0], "stints")
