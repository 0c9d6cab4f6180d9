"""Rating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.registry import query
from hardwood.operators.filters import quarantine, rename_columns
from hardwood.plans import ratings as RT
from hardwood.schemas import HOME_TERM_EPS
from hardwood.session import materialize, scratch_folder
from hardwood.sources.sinks import read_version, write_version

GAMES = """, gm AS (SELECT h.game_id, h.season, h.game_date AS date, h.team_id AS home, a.team_id AS away, h.pts AS home_final, a.pts AS away_final,
     ((h.fga + 0.44e0 * h.fta + h.tov - h.oreb) + (a.fga + 0.44e0 * a.fta + a.tov - a.oreb)) / 2 AS pace
   FROM team_box h JOIN team_box a ON h.game_id = a.game_id AND h.team_home_away = 'home' AND a.team_home_away = 'away' AND h.team_id <> a.team_id),
 games AS (SELECT gm.*, 100e0 * (home_final - away_final) / pace AS home_net, coalesce(s.neutral_site, false) AS neutral
   FROM gm LEFT JOIN schedule s ON s.game_id = gm.game_id WHERE pace > 20)"""

MARGIN = GAMES + """, sd AS (SELECT season, date, home AS team, home_net AS net FROM games UNION ALL SELECT season, date, away, -home_net FROM games),
 gr AS (SELECT d.season, d.date, t.team FROM (SELECT DISTINCT season, date FROM games) d JOIN (SELECT DISTINCT season, team FROM sd) t ON d.season = t.season),
 dy AS (SELECT season, team, date, count(*) AS n, sum(net) AS net FROM sd GROUP BY 1, 2, 3),
 rn AS (SELECT gr.season, gr.team, gr.date, coalesce(sum(dy.n) OVER w, 0) AS n_games, coalesce(sum(dy.net) OVER w, 0e0) AS s FROM gr
   LEFT JOIN dy ON dy.season = gr.season AND dy.team = gr.team AND dy.date = gr.date
   WINDOW w AS (PARTITION BY gr.season, gr.team ORDER BY gr.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 rw AS (SELECT *, n_games / (n_games + 0.3e0) AS w, CASE WHEN n_games > 0 THEN s / n_games ELSE 0 END AS m FROM rn),
 en AS (SELECT season, team, arg_max(w, date) AS w, arg_max(m, date) AS m FROM rw GROUP BY 1, 2),
 eo AS (SELECT *, dense_rank() OVER (ORDER BY season) AS no FROM en),
 pri AS (WITH RECURSIVE c AS (
     SELECT no, season, team, 0e0 AS b0, w * m AS r FROM eo WHERE no = 1
     UNION ALL SELECT e.no, e.season, e.team, coalesce(c.r, 0) * 0.9e0, e.w * e.m + (1 - e.w) * coalesce(c.r, 0) * 0.9e0
     FROM (SELECT max(no) + 1 AS s FROM c) x JOIN eo e ON e.no = x.s LEFT JOIN c ON c.team = e.team AND c.no = e.no - 1)
   SELECT * FROM c),
 tr AS (SELECT season, date, CASE WHEN sum(hn) OVER w > 0 THEN sum(hs) OVER w / sum(hn) OVER w ELSE 0 END AS home_term,
     CASE WHEN sum(nn) OVER w > 0 THEN sum(ns) OVER w / sum(nn) OVER w ELSE 0 END AS neutral_term
   FROM (SELECT season, date, sum((NOT neutral)::int) AS hn, sum(CASE WHEN NOT neutral THEN home_net ELSE 0 END) AS hs, sum(neutral::int) AS nn,
     sum(CASE WHEN neutral THEN home_net ELSE 0 END) AS ns FROM games GROUP BY 1, 2) q
   WINDOW w AS (PARTITION BY season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 mr AS (SELECT rw.season, rw.date, rw.team, rw.w * rw.m + (1 - rw.w) * pri.b0 AS rating, cast(n_games AS int) AS n_games, home_term, neutral_term
   FROM rw JOIN pri ON pri.season = rw.season AND pri.team = rw.team JOIN tr ON tr.season = rw.season AND tr.date = rw.date WHERE n_games > 0 OR pri.b0 <> 0),
 sc AS (SELECT g.*, coalesce(h.rating, 0) AS r_home, coalesce(a.rating, 0) AS r_away, coalesce(h.n_games, 0) AS n_home, coalesce(a.n_games, 0) AS n_away,
     (coalesce(h.rating, 0) - coalesce(a.rating, 0) + coalesce(CASE WHEN g.neutral THEN h.neutral_term ELSE h.home_term END, 0)) * g.pace / 100 AS spread_home,
     home_net * pace / 100 AS actual
   FROM games g LEFT JOIN mr h ON h.season = g.season AND h.date = g.date AND h.team = g.home LEFT JOIN mr a ON a.season = g.season AND a.date = g.date AND a.team = g.away)"""


def _games(t):
    return RT.game_frame(t.team_box, t.schedule)


def _margin(t):
    return RT.margin_ratings(_games(t))


@query("game_frame", ("schedule",), GAMES + " SELECT game_id, season, date, home, away, pace, home_net, neutral FROM games")
def game_frame(t):
    return _games(t).select("game_id", "season", "date", "home", "away", "pace", "home_net", "neutral")


@query(
    "rating_margin_asof", ("schedule",),
    MARGIN + " SELECT season, date, team, round(rating, 6) AS rating, n_games, round(home_term, 6) AS home_term, round(neutral_term, 6) AS neutral_term FROM mr",
)
def rating_margin_asof(t):
    r = lambda c: F.round(c, 6).alias(c)
    return _margin(t).select("season", "date", "team", r("rating"), "n_games", r("home_term"), r("neutral_term"))


@query("rating_ridge_asof")
def rating_ridge_asof(t):
    """Adjusted ratings; equality with a direct dense solve is tested on a fixture."""
    return RT.ridge_ratings(materialize(_games(t)))


@query("rating_ridge_sweep")
def rating_ridge_sweep(t):
    """Accuracy of a small (lambda, decay) grid."""
    g = materialize(_games(t))
    cells = [(lam, d) for lam in (1.0, 3.0) for d in (0.0, 0.9)]
    return RT.method_report(g, RT.ridge_ratings(g, cells))


@query(
    "rating_ondate_margin", ("schedule",),
    MARGIN + """, o AS (SELECT team, count(*) AS n, sum(net) AS s FROM sd WHERE date < DATE '1998-02-01' GROUP BY 1)
      SELECT team, round(s / n * (n / (n + 0.3e0)), 6) AS rating, cast(n AS int) AS n_games FROM o""",
)
def rating_ondate_margin(t):
    return RT.ratings_on(_games(t), "1998-02-01", "margin").select("team", F.round("rating", 6).alias("rating"), "n_games")


# The normal equations of all games before a date, and the same conjugate gradients as a recursion.
_ON_DATE = GAMES + """, e0 AS (SELECT row_number() OVER () AS g, home, away, CASE WHEN neutral THEN '_neutral' ELSE '_home' END AS site, home_net AS y FROM games WHERE date < DATE '1998-02-01'),
 tm AS (SELECT g, home AS name, 1e0 AS s, y FROM e0 UNION ALL SELECT g, away, -1e0, y FROM e0 UNION ALL SELECT g, site, 1e0, y FROM e0),
 mt AS (SELECT a.name AS a, b.name AS b, sum(a.s * b.s) + CASE WHEN a.name <> b.name THEN 0e0 WHEN a.name IN ('_home', '_neutral') THEN """ + f"{HOME_TERM_EPS!r}" + """ ELSE 3e0 END AS v
   FROM tm a JOIN tm b ON a.g = b.g GROUP BY 1, 2),
 sd0 AS (SELECT t.name, t.y, m.v AS d FROM (SELECT name, sum(s * y) AS y FROM tm GROUP BY 1) t JOIN mt m ON m.a = t.name AND m.b = t.name),
 cg AS (WITH RECURSIVE w AS (
   SELECT 0 AS k, name, d, 0e0 AS x, y AS r, y / d AS p FROM sd0
   UNION ALL
   SELECT k + 1, name, d, x + step * p, r - step * q, (r - step * q) / d + rn / rr * p FROM (
     SELECT *, sum((r - step * q) * (r - step * q) / d) OVER () AS rn FROM (
       SELECT *, rr / pq AS step FROM (
         SELECT w.*, m.q, sum(w.r * w.r / w.d) OVER () AS rr, sum(w.p * m.q) OVER () AS pq
         FROM w JOIN (SELECT mt.a, sum(mt.v * w.p) AS q FROM mt JOIN w ON w.name = mt.b GROUP BY mt.a) m ON m.a = w.name) z1) z2) z3
   WHERE k < 400 AND rr > 1e-18)
   SELECT name, x FROM w WHERE k = (SELECT max(k) FROM w))"""


@query(
    "rating_ondate_adjusted", ("schedule",),
    _ON_DATE + """ SELECT cg.name AS team, round(x, 6) AS rating, cast(n AS int) AS n_games FROM cg JOIN (SELECT name, count(*) AS n FROM tm GROUP BY 1) c ON c.name = cg.name
      WHERE cg.name NOT IN ('_home', '_neutral')""",
)
def rating_ondate_adjusted(t):
    """Adjusted ratings of all games before a date, by conjugate gradients."""
    return RT.ratings_on(_games(t), "1998-02-01").select("team", F.round("rating", 6).alias("rating"), "n_games")


@query(
    "rating_ridge_residual", ("schedule",),
    _ON_DATE + " SELECT name, round(y, 6) AS y, true AS solved FROM sd0",
)
def rating_ridge_residual(t):
    """The normal equations at the solution, name by name."""
    earlier = _games(t).where(F.col("date") < "1998-02-01").withColumn("season", F.lit(0))
    entries = materialize(RT.normal_entries(earlier).groupBy("a", "b").agg(F.sum("v").alias("v")))
    left = RT.ridge_residual(entries, RT.ridge_solve(entries))
    y = RT.penalised(entries, RT.RATING_LAMBDA)[1].select("name", F.round("y", 6).alias("y"))
    return left.join(y, "name").select("name", "y", (F.abs("residual") < 1e-6).alias("solved"))


@query(
    "spread_attach", ("schedule",),
    MARGIN + " SELECT game_id, round(spread_home, 6) AS spread_home, round(actual, 6) AS actual, n_home, n_away FROM sc",
)
def spread_attach(t):
    g = materialize(_games(t))
    return RT.attach_ratings(g, RT.margin_ratings(g)).select(
        "game_id", F.round("spread_home", 6).alias("spread_home"), F.round("actual", 6).alias("actual"), "n_home", "n_away"
    )


_SCORES = "count(*) AS n, round(sqrt(avg((actual - spread_home) * (actual - spread_home))), 6) AS rmse, round(corr(actual, spread_home), 6) AS cor, round(regr_slope(actual, spread_home), 6) AS calib_slope"


@query(
    "rating_scores_by_month", ("schedule",),
    MARGIN + f" SELECT cast(month(date) AS int) AS month, {_SCORES} FROM sc WHERE n_home >= 1 AND n_away >= 1 GROUP BY 1",
)
def rating_scores_by_month(t):
    g = materialize(_games(t))
    rep = RT.method_report(g, RT.margin_ratings(g), by=[], extra=[F.month("date").alias("month")])
    return rep.select("month", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "cor", "calib_slope")])


@query(
    "spread_quantiles", ("schedule",),
    MARGIN + " SELECT " + ", ".join(f"round(quantile_cont(spread_home, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)) + " FROM sc",
)
def spread_quantiles(t):
    g = materialize(_games(t))
    q = RT.spread_quantiles(RT.attach_ratings(g, RT.margin_ratings(g)))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def _requests(t):
    return t.schedule.select(
        F.col("game_id").alias("request_id"), F.date_add("game_date", 3).alias("date"), F.col("home_id").alias("home"),
        F.col("away_id").alias("away"), F.col("neutral_site").alias("neutral"),
    )


_ASKED = MARGIN + """, rq AS (SELECT game_id AS request_id, game_date + 3 AS date, home_id AS home, away_id AS away, neutral_site AS neutral FROM schedule),
      td AS (SELECT DISTINCT date AS table_date FROM mr), ad AS (SELECT rq.*, table_date FROM rq ASOF LEFT JOIN td ON td.table_date <= rq.date),
      tp AS (SELECT team, round(avg(pace), 8) AS pace FROM (SELECT home AS team, pace FROM games UNION ALL SELECT away, pace FROM games) q GROUP BY team HAVING count(*) >= 15),
      am AS (SELECT ad.*, h.rating AS rh, a.rating AS ra, CASE WHEN neutral THEN 0 ELSE h.home_term END AS term, coalesce(round_even(round((p.pace + q.pace) / 2, 8), 1), 70.6e0) AS pace,
             CASE WHEN table_date IS NULL THEN 'no table yet' WHEN h.rating IS NULL THEN 'home team not rated' WHEN a.rating IS NULL THEN 'away team not rated' END AS reason
        FROM ad LEFT JOIN mr h ON h.team = ad.home AND h.date = table_date LEFT JOIN mr a ON a.team = ad.away AND a.date = table_date
        LEFT JOIN tp p ON p.team = ad.home LEFT JOIN tp q ON q.team = ad.away)"""


@query("rating_asof_lookup", ("schedule",), _ASKED + " SELECT request_id, round((rh - ra + term) * 70.6e0 / 100, 6) AS spread_home, reason FROM am")
def rating_asof_lookup(t):
    s = RT.matchup_spreads(_requests(t), materialize(_margin(t)))
    return s.select("request_id", F.round("spread_home", 6).alias("spread_home"), "reason")


@query("matchup_pace_spread", ("schedule",), _ASKED + " SELECT request_id, pace, round((rh - ra + term) * pace / 100, 6) AS spread_home FROM am")
def matchup_pace_spread(t):
    """Spread at the pace of the two teams."""
    g = materialize(_games(t))
    s = RT.matchup_spreads(_requests(t), materialize(RT.margin_ratings(g)), RT.team_pace(g))
    return s.select("request_id", "pace", F.round("spread_home", 6).alias("spread_home"))


@query(
    "rating_board", ("schedule",),
    MARGIN + """, pc AS (SELECT team, round_even(round(avg(pace), 8), 1) AS pace, count(*) AS k FROM (SELECT home AS team, pace FROM games WHERE season = (SELECT max(season) FROM games)
        UNION ALL SELECT away, pace FROM games WHERE season = (SELECT max(season) FROM games)) q GROUP BY team HAVING count(*) >= 15)
      SELECT mr.team, concat('Team ', mr.team) AS name, round(rating, 6) AS rating, n_games, coalesce(pc.pace, 70.6e0) AS pace, pc.k AS pace_games
      FROM mr LEFT JOIN pc ON pc.team = mr.team WHERE mr.date = (SELECT max(date) FROM mr)""",
)
def rating_board(t):
    g = materialize(_games(t))
    names = t.schedule.groupBy(F.col("home_id").alias("team")).agg(F.max_by("home_display_name", "game_date").alias("name"))
    b = RT.rating_board(RT.margin_ratings(g), g, names)
    return b.select("team", "name", F.round("rating", 6).alias("rating"), "n_games", "pace", "pace_games")


@query(
    "rating_report", ("schedule",),
    MARGIN + """ SELECT concat('Team ', mr.team) AS team_name, round(rating, 6) AS net_rating, n_games AS games FROM mr WHERE mr.date = (SELECT max(date) FROM mr)""",
)
def rating_report(t):
    """The board trimmed to a report's columns and names; a column that the board doesn't have is left out."""
    g = materialize(_games(t))
    names = t.schedule.groupBy(F.col("home_id").alias("team")).agg(F.max_by("home_display_name", "game_date").alias("name"))
    board = RT.rating_board(RT.margin_ratings(g), g, names).withColumn("rating", F.round("rating", 6))
    return rename_columns(board, {"team_name": "name", "net_rating": "rating", "games": "n_games", "coach": "coach"})


@query(
    "rating_board_snapshot", ("schedule",),
    MARGIN + """ SELECT mr.team, round(rating, 6) AS rating, n_games, CASE WHEN n_games < 100 THEN 'too few games' END AS reject_reason, 1 AS version FROM mr WHERE mr.date = (SELECT max(date) FROM mr)""",
)
def rating_board_snapshot(t):
    """The board as stored and read back: a snapshot of the teams with enough games, the others as its dead letters."""
    g = materialize(_games(t))
    board = RT.rating_board(RT.margin_ratings(g), g).select("team", F.round("rating", 6).alias("rating"), "n_games")
    kept, rejected = quarantine(board, {"too few games": F.col("n_games") >= 100})
    folder = scratch_folder(t.spark, "board")
    version = write_version(kept, rejected, folder)
    rows = read_version(t.spark, folder).withColumn("reject_reason", F.lit(None).cast("string"))
    return rows.unionByName(read_version(t.spark, folder, rejected=True)).withColumn("version", F.lit(version))


_TUNED = ((1.0, 0.0), (3.0, 0.5), (3.0, 0.9), (10.0, 0.9))


def _cell_sql(lam: float, decay: float) -> str:
    body = MARGIN.removeprefix(", ").replace("0.3e0", f"{lam / 10!r}e0").replace("0.9e0", f"{decay!r}e0")
    return (
        f"SELECT {lam!r}e0 AS \"lambda\", {decay!r}e0 AS decay, season, month(date) AS month, actual, spread_home, "
        f"CASE WHEN season = (SELECT max(season) FROM team_box) THEN 'holdout' ELSE 'tune' END AS split FROM (WITH {body} SELECT * FROM sc WHERE n_home >= 1 AND n_away >= 1) z"
    )


@query(
    "rating_tune_holdout", ("schedule",),
    ", al AS (" + " UNION ALL ".join(_cell_sql(*x) for x in _TUNED) + f"""), bc AS (SELECT split, "lambda", decay, {_SCORES} FROM al GROUP BY 1, 2, 3),
      be AS (SELECT "lambda", decay FROM bc WHERE split = 'tune' ORDER BY rmse, "lambda", decay LIMIT 1), mi AS (SELECT al.* FROM al JOIN be ON be."lambda" = al."lambda" AND be.decay = al.decay),
      rs AS (SELECT 'cell' AS level, NULL::int AS part, * FROM bc UNION ALL SELECT 'month', cast(month AS int), split, "lambda", decay, {_SCORES} FROM mi GROUP BY month, split, "lambda", decay
        UNION ALL SELECT 'season', cast(season AS int), split, "lambda", decay, {_SCORES} FROM mi GROUP BY season, split, "lambda", decay)
      SELECT rs.*, be."lambda" IS NOT NULL AS chosen FROM rs LEFT JOIN be ON be."lambda" = rs."lambda" AND be.decay = rs.decay""",
)
def rating_tune_holdout(t):
    """The margin method over a grid, chosen on all seasons but the last and scored on that one."""
    g = materialize(_games(t))
    last = g.agg(F.max("season").alias("s")).first().s
    out = RT.tune_holdout(g, _TUNED, [last], lambda games, lam, decay: RT.margin_ratings(games, lam, decay))
    # as in SQL, a correlation or slope of rows without any spread is not a number, and one of no rows is missing
    undefined = F.when(F.col("n") > 0, F.lit(float("nan")))
    return out.select(
        "level", "split", "lambda", "decay", "part", "n", F.round("rmse", 6).alias("rmse"),
        *[F.coalesce(F.round(c, 6), undefined).alias(c) for c in ("cor", "calib_slope")], "chosen",
    )
