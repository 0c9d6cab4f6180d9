"""Win-probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.events import STATES
from hardwood.catalog.rating import GAMES, MARGIN
from hardwood.catalog.registry import query
from hardwood.operators.aggregates import base_rate_log_loss, bucket_label, log_loss
from hardwood.operators.reshape import to_wide
from hardwood.plans import winprob as WP
from hardwood.session import materialize

EDGES = (0, 5, 30, 120, 300)

TRAIN = STATES + """, gp AS (SELECT game_id, cast(CASE max(league) WHEN 'wnba' THEN 10000 WHEN 'wbb' THEN 20000 WHEN 'mbb' THEN 30000 ELSE 40000 END + max(season) AS int) AS season, max(game_date) AS date,
      concat(max(league), ':', max(home_team_abbrev)) AS home, concat(max(league), ':', max(away_team_abbrev)) AS away, max(home_fill) AS home_final,
      max(away_fill) AS away_final, bool_or(home_team_winner) AS home_win FROM ev GROUP BY 1),
 games AS (SELECT gp.*, k / 2e0 AS pace, 100e0 * (home_final - away_final) / (k / 2e0) AS home_net, false AS neutral FROM gp
   JOIN (SELECT game_id, count(*) AS k FROM po GROUP BY 1) c ON c.game_id = gp.game_id)""" + MARGIN[len(GAMES):] + """,
 tr2 AS (SELECT s.*, cast(sc.season % 10000 AS int) AS season, sc.date, sc.home_win, sc.spread_home, least(n_home, n_away) AS rating_n_min, CASE WHEN ball_is_home THEN spread_home ELSE -spread_home END AS spread_ball,
      home_win = ball_is_home AS ball_win FROM states s LEFT JOIN sc ON sc.game_id = s.game_id),
 good AS (SELECT * FROM tr2 WHERE home_win IS NOT NULL AND ball_team IS NOT NULL AND ball_win IS NOT NULL),
 ft2 AS (SELECT *, sqrt(cast(greatest(secs_left_game, 0) AS double)) AS t, cast(month(date) AS int) AS mon FROM good WHERE is_pure AND secs_left_game IS NOT NULL),
 pp AS (SELECT *, least(greatest(1 / (1 + exp(-(ball_margin + 0.2e0 * spread_ball) / (1 + 0.4e0 * t))), 1e-6), 1 - 1e-6) AS p FROM ft2)"""


def _training(t):
    return WP.training_set(t.pbp)


def _features(t):
    return materialize(WP.features(_training(t)[0]).where(F.col("secs_left_game").isNotNull()))


def _simple_scored(t):
    """A stated closed-form probability, so the score tables can be checked elsewhere."""
    z = (F.col("ball_margin") + 0.2 * F.col("spread_ball")) / (1 + 0.4 * F.col("t"))
    p = F.lit(1.0) / (1 + F.exp(-z))
    return _features(t).withColumn("p", F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))


@query(
    "training_set", ("pbp",),
    TRAIN + """ SELECT game_id, idx, is_pure, state, season, ball_margin, round(spread_home, 6) AS spread_home, round(spread_ball, 6) AS spread_ball, ball_win, rating_n_min FROM good""",
)
def training_set(t):
    r = lambda c: F.round(c, 6).alias(c)
    return _training(t)[0].select(
        "game_id", "idx", "is_pure", "state", "season", "ball_margin", r("spread_home"), r("spread_ball"), "ball_win", "rating_n_min"
    )


@query(
    "training_quarantine", ("pbp",),
    TRAIN + """ SELECT CASE WHEN home_win IS NULL THEN 'no final score' WHEN ball_team IS NULL THEN 'no team' ELSE 'no label' END AS reject_reason, count(*) AS n
      FROM tr2 WHERE home_win IS NULL OR ball_team IS NULL OR ball_win IS NULL GROUP BY 1""",
)
def training_quarantine(t):
    return _training(t)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


_BIN = lambda a, w: f"floor({a} / {w} + 0.5e0) * {w}"
BINS = f"""SELECT {_BIN('t', '1e0')} AS t, {_BIN('ball_margin', '1e0')} AS ball_margin,
   {_BIN('round(spread_ball, 9)', '3e0')} AS spread_ball, count(*) AS n, cast(sum(ball_win::int) AS bigint) AS wins FROM ft2 GROUP BY 1, 2, 3"""


@query("winprob_binned", ("pbp",), TRAIN + " " + BINS)
def winprob_binned(t):
    rows = _features(t).withColumn("spread_ball", F.round("spread_ball", 9))
    return WP.binned(rows)


@query(
    "game_folds", ("pbp",),
    """ SELECT game_id, cast(cast(('0x' || substr(md5('1:' || game_id), 1, 7)) AS bigint) % 5 AS int) AS fold FROM (SELECT DISTINCT game_id FROM pbp) q""",
)
def game_folds(t):
    return t.pbp.select("game_id").distinct().select("game_id", WP.game_fold("game_id", 5).alias("fold"))


@query(
    "calibration_bins", ("pbp",),
    TRAIN + """ SELECT cast(greatest(ceil(p * 10), 1) AS int) AS bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(ball_win::int), 6) AS actual,
      round(avg(ball_win::int) - avg(p), 6) AS gap FROM pp GROUP BY 1""",
)
def calibration_bins(t):
    c = WP.calibration(_simple_scored(t))
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_pred", "actual", "gap")])


_LL = "round(-avg(CASE WHEN ball_win THEN ln({p}) ELSE ln(1 - {p}) END), 6)"
_LEAD = "(CASE WHEN ball_margin > 0 THEN 0.99e0 WHEN ball_margin < 0 THEN 0.01e0 ELSE 0.5e0 END)"


@query(
    "endgame_buckets", ("pbp",),
    TRAIN + f""" SELECT CASE WHEN secs_left_game < 5 THEN '0-5' WHEN secs_left_game < 30 THEN '5-30' WHEN secs_left_game < 120 THEN '30-120' WHEN secs_left_game < 300 THEN '120-300' ELSE '300+' END AS bucket,
      count(*) AS n, {_LL.format(p='p')} AS log_loss, {_LL.format(p=_LEAD)} AS leader_log_loss FROM pp GROUP BY 1""",
)
def endgame_buckets(t):
    s = WP.evaluate(_simple_scored(t), [bucket_label("secs_left_game", EDGES).alias("bucket")])
    return s.select("bucket", "n", F.round("log_loss", 6).alias("log_loss"), F.round("leader_log_loss", 6).alias("leader_log_loss"))


@query(
    "score_metrics", ("pbp",),
    TRAIN + f""", r AS (SELECT mon, avg(ball_win::int) AS r FROM pp GROUP BY 1)
      SELECT pp.mon AS month, count(*) AS n, {_LL.format(p='p')} AS log_loss, round(avg((ball_win::int - p) * (ball_win::int - p)), 6) AS brier,
        round(min(-(r * ln(r) + (1 - r) * ln(1 - r))), 6) AS base_log_loss FROM pp JOIN r ON r.mon = pp.mon GROUP BY 1""",
)
def score_metrics(t):
    s = _simple_scored(t)
    a = WP.evaluate(s, [F.col("month")])
    return a.join(base_rate_log_loss(s, "ball_win", ["month"]), "month").select(
        "month", "n", *[F.round(x, 6).alias(x) for x in ("log_loss", "brier", "base_log_loss")]
    )


@query(
    "loss_wide", ("pbp",),
    TRAIN + f""" SELECT season, max(CASE WHEN b = 'early' THEN l END) AS early, max(CASE WHEN b = 'late' THEN l END) AS late FROM (
      SELECT season, CASE WHEN secs_left_game >= 300 THEN 'early' ELSE 'late' END AS b, {_LL.format(p='p')} AS l FROM pp GROUP BY 1, 2) q GROUP BY season""",
)
def loss_wide(t):
    b = F.when(F.col("secs_left_game") >= 300, "early").otherwise("late").alias("b")
    long = _simple_scored(t).groupBy("season", b).agg(F.round(log_loss("ball_win", "p"), 6).alias("l"))
    return to_wide(long, ["season"], "b", ["early", "late"], "l")


def _wp_sql(m: str, sp: str = "spread_ball") -> str:
    return f"(1 / (1 + exp(-(({m}) + 0.2e0 * {sp}) / (1 + 0.4e0 * t))))"


def _ft_sql(j: int, s: int) -> str:
    w = lambda k: _wp_sql(f"ball_margin + {k}")
    n = lambda k: f"(1 - {_wp_sql(f'-(ball_margin + {k})', '(-spread_ball)')})"
    if s <= 1:
        return f"(0.71e0 * {n(j + 1)} + 0.29e0 * (0.2e0 * {w(j)} + 0.8e0 * {n(j)}))"
    return f"(0.71e0 * {_ft_sql(j + 1, s - 1)} + 0.29e0 * {_ft_sql(j, s - 1)})"


@query(
    "winprob_ft_states", ("pbp",),
    TRAIN + f""", f AS (SELECT *, sqrt(cast(greatest(secs_left_game, 0) AS double)) AS t FROM good WHERE NOT is_pure AND secs_left_game IS NOT NULL)
      SELECT game_id, idx, round(CASE WHEN ft_shots_remaining = 1 THEN {_ft_sql(0, 1)} WHEN ft_shots_remaining = 2 THEN {_ft_sql(0, 2)} WHEN ft_shots_remaining = 3 THEN {_ft_sql(0, 3)} END, 8) AS win_prob FROM f""",
)
def winprob_ft_states(t):
    secs = F.col("secs_left_game")
    rows = _training(t)[0].where(~F.col("is_pure") & secs.isNotNull()).withColumn(
        "t", F.sqrt(F.when(secs < 0, 0).otherwise(secs).cast("double"))
    )
    s, m = F.col("spread_ball"), F.col("ball_margin")
    wp = lambda margin, spread: F.lit(1.0) / (1 + F.exp(-(margin + 0.2 * spread) / (1 + 0.4 * F.col("t"))))
    with_ball = lambda x: wp(x, s)
    without = lambda x: F.lit(1.0) - wp(-x, -s)
    v = lambda k: WP.free_throw_value(with_ball, without, m, k)
    p = F.when(F.col("ft_shots_remaining") == 1, v(1)).when(F.col("ft_shots_remaining") == 2, v(2)).when(F.col("ft_shots_remaining") == 3, v(3))
    return rows.select("game_id", "idx", F.round(p, 8).alias("win_prob"))


@query("winprob_model")
def winprob_model(t):
    """Local logistic fit scored on held-out games by time bucket."""
    fit, held = WP.split_games(_features(t))
    v = materialize(WP.fit_vertices(WP.binned(fit)))
    return WP.evaluate(WP.predict(held, v), [bucket_label("secs_left_game", EDGES).alias("bucket")])


@query("winprob_cv")
def winprob_cv(t):
    """Whole-game cross validation over two neighbourhood shares."""
    return WP.cross_validate(_features(t), (0.2, 0.5), 3)


@query("winprob_surface")
def winprob_surface(t):
    """Situation surface, wide by margin, from the fitted model."""
    v = materialize(WP.fit_vertices(WP.binned(_features(t))))
    grid = WP.predict(WP.situation_surface(t.spark, [-10, -5, -2, 0, 2, 5, 10], [5, 30, 60, 120, 300, 600, 1200, 2400]), v)
    named = grid.withColumn("m", F.format_string("m%d", F.col("ball_margin").cast("int")))
    return to_wide(named, ["secs"], "m", [f"m{m}" for m in (-10, -5, -2, 0, 2, 5, 10)], "p")


@query("winprob_calculator")
def winprob_calculator(t):
    """Every moment of the training set as a situation of the batch calculator."""
    rows = materialize(_training(t)[0].where(F.col("secs_left_game").isNotNull()))
    v = materialize(WP.fit_vertices(WP.binned(WP.features(rows))))
    s = rows.select(
        F.concat_ws("|", "game_id", "idx", "state_type", "state", "ball_team").alias("situation_id"), F.col("secs_left_game").alias("secs"),
        F.col("ball_margin").cast("double").alias("ball_margin"), "spread_ball", F.lit(True).alias("has_ball"),
        F.coalesce("ft_shots_remaining", F.lit(0)).alias("ft_shots"),
    )
    return WP.score_situations(s, v)


# A given surface: its logit is a product form that linear interpolation in each axis gives back exactly, inside and beyond
# the vertices, so lookups and rules can be checked without the fit.
def _given(t):
    m, s, x = F.col("ball_margin"), F.col("spread_ball"), F.col("t")
    logit = 0.1 * m + 0.03 * s - 0.01 * x + 0.004 * m * x
    return WP.vertex_table(t.spark).withColumn("p", F.lit(1.0) / (1 + F.exp(-logit)))


def _given_sql(m: str, s: str, x: str) -> str:
    return f"least(greatest(1 / (1 + exp(-(0.1e0 * ({m}) + 0.03e0 * ({s}) - 0.01e0 * {x} + 0.004e0 * ({m}) * {x}))), 1e-6), 1 - 1e-6)"


def _given_trip(j: int, shots: int) -> str:
    w = lambda k: _given_sql(f"ball_margin + {k}", "spread_ball", "t")
    n = lambda k: f"(1 - {_given_sql(f'-(ball_margin + {k})', '-spread_ball', 't')})"
    if shots == 0:
        return w(j)
    if shots == 1:
        return f"(0.71e0 * {n(j + 1)} + 0.29e0 * (0.2e0 * {w(j)} + 0.8e0 * {n(j)}))"
    return f"(0.71e0 * {_given_trip(j + 1, shots - 1)} + 0.29e0 * {_given_trip(j, shots - 1)})"


@query(
    "winprob_predict_given", ("pbp",),
    TRAIN + f" SELECT game_id, idx, round({_given_sql('ball_margin', 'spread_ball', 't')}, 8) AS p FROM ft2",
)
def winprob_predict_given(t):
    """Interpolation of a given surface at every training moment."""
    return WP.predict(_features(t), _given(t)).select("game_id", "idx", F.round("p", 8).alias("p"))


@query(
    "winprob_calculator_given", ("pbp",),
    TRAIN + f""", f AS (SELECT *, coalesce(ft_shots_remaining, 0) AS k, sqrt(cast(greatest(secs_left_game, 0) AS double)) AS t FROM good WHERE secs_left_game IS NOT NULL)
      SELECT concat_ws('|', game_id, idx, state_type, state, ball_team) AS situation_id, round(CASE WHEN secs_left_game <= 0 AND k = 0 THEN CASE WHEN ball_margin > 0 THEN 1 WHEN ball_margin < 0 THEN 0
          ELSE ({_given_sql('0e0', 'spread_ball', 'sqrt(300e0)')} + 1 - {_given_sql('0e0', '-spread_ball', 'sqrt(300e0)')}) / 2 END
        WHEN k = 0 AND idx % 3 = 0 THEN 1 - {_given_sql('-ball_margin', '-spread_ball', 't')} WHEN k = 0 THEN {_given_trip(0, 0)} WHEN k = 1 THEN {_given_trip(0, 1)} WHEN k = 2 THEN {_given_trip(0, 2)} WHEN k = 3 THEN {_given_trip(0, 3)} END, 8) AS win_prob FROM f""",
)
def winprob_calculator_given(t):
    """The batch calculator's rules on a given surface; a third of the moments are taken as the side without the ball."""
    rows = _training(t)[0].where(F.col("secs_left_game").isNotNull())
    with_ball = (F.coalesce("ft_shots_remaining", F.lit(0)) > 0) | (F.col("idx") % 3 != 0)
    s = rows.select(
        F.concat_ws("|", "game_id", "idx", "state_type", "state", "ball_team").alias("situation_id"), F.col("secs_left_game").alias("secs"),
        F.col("ball_margin").cast("double").alias("ball_margin"), "spread_ball", with_ball.alias("has_ball"),
        F.coalesce("ft_shots_remaining", F.lit(0)).alias("ft_shots"),
    )
    return WP.score_situations(materialize(s), _given(t)).select("situation_id", F.round("win_prob", 8).alias("win_prob"))


_MARGINS, _SECONDS = (-10, -5, -2, 0, 2, 5, 10), (5, 30, 60, 120, 300, 600, 1200, 2400)


@query(
    "winprob_surface_given", ("pbp",),
    TRAIN + f", sp AS (SELECT round(avg(spread_ball), 4) AS s FROM ft2) SELECT secs, "
    + ", ".join(f"round({_given_sql(f'{m}e0', 's', 'sqrt(secs::double)')}, 8) AS \"m{m}\"" for m in _MARGINS) + f" FROM (SELECT unnest({list(_SECONDS)}) AS secs) q, sp",
)
def winprob_surface_given(t):
    """The situation surface at the mean spread of the training moments, from a given surface."""
    spread = _features(t).agg(F.round(F.avg("spread_ball"), 4).alias("s")).first().s
    grid = WP.predict(WP.situation_surface(t.spark, _MARGINS, _SECONDS, spread), _given(t)).withColumn("p", F.round("p", 8))
    named = grid.withColumn("m", F.format_string("m%d", F.col("ball_margin").cast("int")))
    return to_wide(named, ["secs"], "m", [f"m{m}" for m in _MARGINS], "p")


def _vertices_sql() -> str:
    axis = lambda a, i: f"(SELECT unnest(range({len(WP.AXES[a]['vertices'])})) AS {i}, unnest({WP.AXES[a]['vertices']}) AS v{i})"
    return f"vx AS (SELECT i, j, k, vi, vj, vk FROM {axis('t', 'i')} a, {axis('ball_margin', 'j')} b, {axis('spread_ball', 'k')} c)"


@query(
    "winprob_bandwidth", ("pbp",),
    TRAIN + f""", bi AS ({BINS}), {_vertices_sql()},
      ds AS (SELECT i, j, k, n, sqrt((t - vi) * (t - vi) + (ball_margin - vj) * (ball_margin - vj) + (spread_ball - vk) * (spread_ball - vk)) AS d FROM vx, bi),
      cu AS (SELECT i, j, k, d, sum(n) OVER (PARTITION BY i, j, k ORDER BY d) AS upto, (SELECT sum(n) FROM bi) AS total FROM ds)
      SELECT i, j, k, round(greatest(min(d) FILTER (upto >= 0.1e0 * total) * 1.0001e0, 1e-6), 6) AS h FROM cu GROUP BY 1, 2, 3""",
)
def winprob_bandwidth(t):
    """How far each vertex of the fit reaches."""
    rows = _features(t).withColumn("spread_ball", F.round("spread_ball", 9))
    return WP.fit_vertices(WP.binned(rows)).select("i", "j", "k", F.round("h", 6).alias("h"))
