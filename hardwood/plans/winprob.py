"""Win-probability training rows, local logistic model, evaluation and batch calculator.

The model is fitted on counts over a fixed grid of (t, margin, spread) bins, so after one
aggregation its input is bounded by the grid and not by the number of moments. Each grid vertex
gets its own weighted local fit in parallel; prediction is a join on grid cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.functions.metrics import _c, clamp, net_per_100
from hardwood.operators.aggregates import bucket_label, calibration_table, leader_probability, log_loss, brier
from hardwood.operators.filters import quarantine
from hardwood.plans.possessions import game_states, possession_rows, possession_state, prepared_events
from hardwood.plans.ratings import attach_ratings, by_league, margin_ratings
from hardwood.schemas import FT_MAKE, FT_OREB_KEEP
from hardwood.session import materialize, spread

# Bin width and vertex positions per axis. Bins are centred on multiples of the width, so a tie and a one-point lead are
# bins of their own. Values beyond the outer vertices extrapolate the logit of the end cells.
AXES = {
    "t": {"bin": 1.0, "vertices": [0.0, 3.0, 6.0, 10.0, 15.0, 22.0, 30.0, 40.0, 49.0]},
    "ball_margin": {"bin": 1.0, "vertices": [-40.0, -25.0, -15.0, -10.0, *[float(m) for m in range(-6, 7)], 10.0, 15.0, 25.0, 40.0]},
    "spread_ball": {"bin": 3.0, "vertices": [-30.0, -18.0, -9.0, 0.0, 9.0, 18.0, 30.0]},
}


def event_games(ev: DataFrame) -> DataFrame:
    """One row per game of possession rows: sides, final score, possessions-based pace, winner."""
    g = ev.groupBy("game_id").agg(
        F.max("league").alias("league"), F.max("season").alias("season"), F.max("game_date").alias("date"), F.max("home_team_abbrev").alias("home"),
        F.max("away_team_abbrev").alias("away"), F.max("home_fill").alias("home_final"), F.max("away_fill").alias("away_final"),
        F.bool_or("home_team_winner").alias("home_win"),
    )
    pace = possession_state(ev).groupBy("game_id").agg((F.count(F.lit(1)) / 2).alias("pace"))
    return g.join(pace, "game_id").withColumns({
        "home_net": net_per_100("home_final", "away_final", "pace"), "neutral": F.lit(False),
    })


def training_rows(states: DataFrame, games: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled moments with rating context, quarantined moments with their reason). Games and ratings come `by_league`."""
    c = F.col
    ctx = attach_ratings(games, ratings).select(
        "game_id", (c("season") % 10_000).alias("season"), "date", "home_win", "spread_home", F.least("n_home", "n_away").alias("rating_n_min")
    )
    rows = states.join(ctx, "game_id", "left").withColumns({
        "spread_ball": F.when(c("ball_is_home"), c("spread_home")).otherwise(-c("spread_home")),
        "ball_win": c("home_win") == c("ball_is_home"),
    })
    return quarantine(rows, {
        "no final score": c("home_win").isNotNull(),
        "no team": c("ball_team").isNotNull(),
        "no label": c("ball_win").isNotNull(),
    })


def training_set(pbp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed to labelled moments. Possession rows and games are written once, being read repeatedly."""
    rows = spread(materialize(possession_rows(prepared_events(pbp))), "game_id")
    games = materialize(by_league(event_games(rows)))
    return training_rows(game_states(rows), games, margin_ratings(games))


def features(rows: DataFrame) -> DataFrame:
    secs = F.col("secs_left_game")
    return rows.where("is_pure").withColumns({
        "t": F.sqrt(F.when(secs < 0, 0).otherwise(secs).cast("double")), "month": F.month("date"),
    })


def game_fold(game_id, k: int, seed: int = 1) -> Column:
    """Fold of a whole game from a hash, equal on every engine and run."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(game_id))), 1, 7)
    return F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(k)).cast("int")


def split_games(rows: DataFrame, holdout_percent: int = 15, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    f = game_fold("game_id", 100, seed)
    return rows.where(f >= holdout_percent), rows.where(f < holdout_percent)


def _bin(axis: str) -> Column:
    width = AXES[axis]["bin"]
    return F.floor(F.col(axis).cast("double") / width + 0.5) * width


def binned(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments and wins per grid bin."""
    ready = rows.where(F.col("t").isNotNull() & F.col("ball_margin").isNotNull() & F.col("spread_ball").isNotNull())
    return ready.groupBy(*by, *[_bin(a).alias(a) for a in AXES]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ball_win").cast("int")).alias("wins")
    )


def vertex_table(spark: SparkSession) -> DataFrame:
    ix = [[(i, v) for i, v in enumerate(AXES[a]["vertices"])] for a in AXES]
    rows = [(i, j, k, x, y, z) for i, x in ix[0] for j, y in ix[1] for k, z in ix[2]]
    return spark.createDataFrame(rows, "i int, j int, k int, t double, ball_margin double, spread_ball double")


def bandwidth(d: np.ndarray, n: np.ndarray, nn: float) -> float:
    """The distance within which the share nn of all moments lies, and a little more."""
    order = np.argsort(d, kind="stable")
    reach = np.searchsorted(np.cumsum(n[order]), nn * n.sum())
    return max(d[order[min(reach, len(d) - 1)]] * 1.0001, 1e-6)


def local_logit(x: np.ndarray, n: np.ndarray, wins: np.ndarray, at: np.ndarray, nn: float) -> float:
    """Local quadratic logistic value at one point from binned counts (tricube, nearest share nn)."""
    return local_fit(x, n, wins, at, nn)[0]


def local_fit(x: np.ndarray, n: np.ndarray, wins: np.ndarray, at: np.ndarray, nn: float) -> tuple[float, float]:
    """The value of `local_logit`, and the bandwidth."""
    d = np.sqrt(((x - at) ** 2).sum(axis=1))
    h = bandwidth(d, n, nn)
    near = d < h
    w = n[near] * (1 - (d[near] / h) ** 3) ** 3
    z = (x[near] - at) / h
    cols = [np.ones(len(z)), z[:, 0], z[:, 1], z[:, 2]]
    cols += [z[:, a] * z[:, b] for a in range(3) for b in range(a, 3)]
    m = np.column_stack(cols)
    y = wins[near] / n[near]
    base = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    beta = np.zeros(m.shape[1])
    beta[0] = np.log(base / (1 - base))
    penalty = np.full(m.shape[1], 1e-3)
    penalty[0] = 1e-8
    centre = beta.copy()
    for _ in range(25):
        eta = np.clip(m @ beta, -12, 12)
        p = 1 / (1 + np.exp(-eta))
        v = w * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(
            (m * v[:, None]).T @ m + np.diag(penalty), m.T @ (w * (y - p)) - penalty * (beta - centre)
        )
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(1 / (1 + np.exp(-np.clip(beta[0], -12, 12)))), float(h)


#: Parts that the vertices of a fit are dealt into; each part gets all bins, which the grid bounds.
FIT_PARTS = 16


def fit_vertices(bins: DataFrame, nn: Sequence[float] = (0.1,), folds: int | None = None) -> DataFrame:
    """Fitted probability p and bandwidth h per vertex, neighbourhood share and (when folds are given) left-out fold.

    The bins bound the counts (minutes, points and spread steps of a game, for each fold). Vertices and bins meet part by part
    in the tasks; nothing goes through the driver.
    """
    spark = bins.sparkSession
    counts = bins.select(*([F.col("fold")] if folds else [F.lit(-1).alias("fold")]), "t", "ball_margin", "spread_ball", "n", "wins")
    counts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FIT_PARTS - 1))))
    jobs = vertex_table(spark).withColumn("nn", F.explode(F.array(*[F.lit(float(x)) for x in nn])))
    jobs = jobs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))) if folds else F.lit(-1))
    jobs = jobs.withColumn("_part", F.pmod(F.xxhash64("i", "j", "k", "nn", "fold"), F.lit(FIT_PARTS)).cast("int"))

    def fit(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["fold", "t", "ball_margin", "spread_ball"])
        x = held[["t", "ball_margin", "spread_ball"]].to_numpy(float)
        n, wins, fold = held["n"].to_numpy(float), held["wins"].to_numpy(float), held["fold"].to_numpy()
        out = []
        for r in asked.itertuples(index=False):
            use = fold != r.fold if r.fold >= 0 else np.ones(len(n), dtype=bool)
            out.append(local_fit(x[use], n[use], wins[use], np.array([r.t, r.ball_margin, r.spread_ball]), r.nn) if use.any() else (None, None))
        return asked.drop(columns="_part").assign(p=[o[0] for o in out], h=[o[1] for o in out])

    return jobs.groupBy("_part").cogroup(counts.groupBy("_part")).applyInPandas(
        fit, "i int, j int, k int, t double, ball_margin double, spread_ball double, nn double, fold int, p double, h double"
    )


def _cell(axis: str) -> tuple[Column, Column]:
    """(cell index, position inside the cell) of a value on an axis; outside 0..1 beyond the end vertices."""
    v = AXES[axis]["vertices"]
    x = F.col(axis).cast("double")
    cell = F.lit(0)
    pos = (x - v[0]) / (v[1] - v[0])
    for i in range(1, len(v) - 1):
        cell = F.when(x >= v[i], F.lit(i)).otherwise(cell)
        pos = F.when(x >= v[i], (x - v[i]) / (v[i + 1] - v[i])).otherwise(pos)
    return cell, pos


def predict(rows: DataFrame, vertices: DataFrame, by: Sequence[str] = (), out: str = "p") -> DataFrame:
    """Probability from the trilinear logit of the eight corners of each row's cell, clamped away from 0 and 1."""
    c = F.col
    inner = clamp(c("p"), 1e-6, 1 - 1e-6)
    logit = F.log(inner / (1 - inner))
    corners = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(d).alias("dk")) for a in (0, 1) for b in (0, 1) for d in (0, 1)])
    cells = vertices.select(*by, "i", "j", "k", "p", F.inline(corners)).groupBy(
        *by, (c("i") - c("di")).alias("_ci"), (c("j") - c("dj")).alias("_cj"), (c("k") - c("dk")).alias("_ck")
    ).agg(*[
        F.max(F.when((c("di") == a) & (c("dj") == b) & (c("dk") == d), logit)).alias(f"_p{a}{b}{d}")
        for a in (0, 1) for b in (0, 1) for d in (0, 1)
    ])
    ci, pi = _cell("t")
    cj, pj = _cell("ball_margin")
    ck, pk = _cell("spread_ball")
    keyed = rows.withColumns({"_ci": ci, "_cj": cj, "_ck": ck, "_u": pi, "_v": pj, "_w": pk})
    # the cell table has one row per grid cell: a fixed, small number
    joined = keyed.join(F.broadcast(cells), [*by, "_ci", "_cj", "_ck"], "left")
    part = lambda x, on: c(x) if on else F.lit(1.0) - c(x)
    value = sum(
        (c(f"_p{a}{b}{d}") * part("_u", a) * part("_v", b) * part("_w", d) for a in (0, 1) for b in (0, 1) for d in (0, 1)),
        F.lit(0.0),
    )
    drop = ["_ci", "_cj", "_ck", "_u", "_v", "_w"] + [f"_p{a}{b}{d}" for a in (0, 1) for b in (0, 1) for d in (0, 1)]
    return joined.withColumn(out, clamp(1 / (1 + F.exp(-value)), 1e-6, 1 - 1e-6)).drop(*drop)


def cross_validate(rows: DataFrame, nn: Sequence[float] = (0.1, 0.3), folds: int = 5, edges=(0, 5, 30, 120, 300)) -> DataFrame:
    """Held-out log loss per neighbourhood share and time bucket, whole games per fold."""
    data = rows.withColumn("fold", game_fold("game_id", folds))
    fitted = fit_vertices(binned(data, ["fold"]), nn, folds)
    grid = data.withColumn("nn", F.explode(F.array(*[F.lit(float(x)) for x in nn])))
    scored = predict(grid, fitted.select("i", "j", "k", "nn", "fold", "p"), ["nn", "fold"])
    return scored.groupBy("nn", bucket_label("secs_left_game", edges).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), log_loss("ball_win", "p").alias("log_loss"),
        log_loss("ball_win", leader_probability("ball_margin")).alias("leader_log_loss"),
    )


def evaluate(scored: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    y = F.avg(F.col("ball_win").cast("double"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), log_loss("ball_win", "p").alias("log_loss"), brier("ball_win", "p").alias("brier"),
        log_loss("ball_win", leader_probability("ball_margin")).alias("leader_log_loss"), y.alias("base_rate"),
    )


def calibration(scored: DataFrame) -> DataFrame:
    return calibration_table(scored, "ball_win", "p")


def situation_surface(spark: SparkSession, margins: Sequence[int], seconds: Sequence[int], spread: float = 0.0) -> DataFrame:
    """Grid of game situations with the ball."""
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("ball_margin"), F.lit(float(spread)).alias("spread_ball")
    ).withColumn("secs", F.explode(F.array(*[F.lit(int(s)) for s in seconds]))).withColumn("t", F.sqrt(F.col("secs").cast("double")))


def free_throw_value(with_ball: Callable[[Column], Column], without: Callable[[Column], Column], margin: Column, shots: int,
                     make: float = FT_MAKE, keep: float = FT_OREB_KEEP) -> Column:
    """Win probability of the shooting team with `shots` free throws left."""
    if shots <= 1:
        miss = keep * with_ball(margin) + (1 - keep) * without(margin)
        return make * without(margin + 1) + (1 - make) * miss
    rest = lambda m: free_throw_value(with_ball, without, m, shots - 1, make, keep)
    return make * rest(margin + 1) + (1 - make) * rest(margin)


def score_situations(situations: DataFrame, vertices: DataFrame) -> DataFrame:
    """Win probability of (situation_id, secs, ball_margin, spread_ball, has_ball, ft_shots) rows.

    The margins a situation can reach (one for each free throw) are looked up with and without the ball, then
    combined; decided and level games at zero seconds follow exact rules.
    """
    c = F.col
    longest = situations.agg(F.max("ft_shots").alias("n")).first().n or 0
    step = F.explode(F.sequence(F.lit(0), F.coalesce(c("ft_shots"), F.lit(0))))
    asked = situations.withColumn("_j", step).select(
        "situation_id", "_j", F.inline(F.array(
            F.struct(F.lit("w").alias("_k"), (c("ball_margin") + c("_j")).alias("ball_margin"), c("spread_ball").alias("spread_ball"), c("secs").alias("_s")),
            F.struct(F.lit("n").alias("_k"), (-(c("ball_margin") + c("_j"))).alias("ball_margin"), (-c("spread_ball")).alias("spread_ball"), c("secs").alias("_s")),
        ))
    )
    over = situations.where((c("secs") <= 0) & (c("ball_margin") == 0)).select("situation_id", F.lit(-1).alias("_j"), F.inline(F.array(
        F.struct(F.lit("w").alias("_k"), F.lit(0.0).alias("ball_margin"), c("spread_ball").alias("spread_ball"), F.lit(300).alias("_s")),
        F.struct(F.lit("n").alias("_k"), F.lit(0.0).alias("ball_margin"), (-c("spread_ball")).alias("spread_ball"), F.lit(300).alias("_s")),
    )))
    looked = predict(
        asked.unionByName(over).withColumn("t", F.sqrt(F.when(c("_s") < 0, 0).otherwise(c("_s")).cast("double"))), vertices
    ).withColumn("p", F.when(c("_k") == "n", 1 - c("p")).otherwise(c("p")))
    name = lambda k, j: f"_{k}{'o' if j < 0 else j}"
    wide = looked.groupBy("situation_id").agg(*[
        F.max(F.when((c("_k") == k) & (c("_j") == j), c("p"))).alias(name(k, j)) for k in ("w", "n") for j in range(-1, longest + 1)
    ])
    at = lambda k: (lambda m: c(name(k, m)))

    def last(j: int) -> Column:
        """The last free throw, after j made ones."""
        return FT_MAKE * at("n")(j + 1) + (1 - FT_MAKE) * (FT_OREB_KEEP * at("w")(j) + (1 - FT_OREB_KEEP) * at("n")(j))

    def ft(shots: int) -> Column:
        # the free throws before the last one only move the margin: binomial counts of made ones
        n = shots - 1
        return sum((math.comb(n, m) * FT_MAKE**m * (1 - FT_MAKE) ** (n - m) * last(m) for m in range(n + 1)), F.lit(0.0))

    live = F.when(~c("has_ball"), c("_n0"))
    for s in range(1, longest + 1):
        live = live.when(c("ft_shots") == s, ft(s))
    live = live.otherwise(c("_w0"))
    done = (c("secs") <= 0) & (F.coalesce(c("ft_shots"), F.lit(0)) == 0)
    p = (
        F.when(done & (c("ball_margin") > 0), 1.0).when(done & (c("ball_margin") < 0), 0.0)
        .when(done, (c("_wo") + c("_no")) / 2).otherwise(live)
    )
    return situations.join(wide, "situation_id").withColumn("win_prob", p).select(*situations.columns, "win_prob")
