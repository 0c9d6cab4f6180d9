"""Sum-then-ratio aggregation, weighted means, model scores and reconciliation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.metrics import PAIRED_COUNTS, _c, clamp, with_team_metrics


def aggregate_games(df: DataFrame, *by, ft_coef: float = 0.44, estimator: str = "oliver") -> DataFrame:
    """Sum the counts over the groups (or over everything), then recompute the ratios."""
    counts = list(PAIRED_COUNTS)
    extra = []
    if "game_minutes" in df.columns:
        counts.append("game_minutes")
        # share of games whose length is known: missing lengths inflate pace
        extra = [(F.count("game_minutes") / F.count(F.lit(1))).alias("minutes_coverage")]
    total = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in counts], *extra
    )
    return with_team_metrics(total, ft_coef, estimator)


def weighted_mean(x, w) -> Column:
    x, w = _c(x), _c(w)
    ok = x.isNotNull() & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def last_n(df: DataFrame, team: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """Latest n rows per team; the rank limit is applied before the shuffle as well as after."""
    w = Window.partitionBy(*team).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return last_n(df, keys, k, order)


def latest_attributes(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], order: Sequence[str]) -> list[Column]:
    """`max_by` columns giving each attribute of the last row in the given order."""
    # one aggregate for all of them, so a half-made group carries the order once
    last = F.max_by(F.struct(*attributes), F.struct(*order))
    return [last[a].alias(a) for a in attributes]


def leave_one_out_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the other members of the group."""
    w = Window.partitionBy(*keys)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    x = F.col(value)
    others = n - F.when(x.isNotNull(), 1).otherwise(0)
    return df.withColumn(out, F.when(others > 0, (s - F.coalesce(x, F.lit(0.0))) / others))


def regression_scores(actual, predicted) -> list[Column]:
    """RMSE, correlation and slope of actual on predicted."""
    a, p = _c(actual), _c(predicted)
    return [
        F.count(F.when(a.isNotNull() & p.isNotNull(), 1)).alias("n"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.corr(a, p).alias("cor"),
        F.regr_slope(a, p).alias("calib_slope"),
    ]


def log_loss(y, p) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return -F.avg(F.when(_c(y), F.log(q)).otherwise(F.log(F.lit(1.0) - q)))


def brier(y, p) -> Column:
    d = F.when(_c(y), F.lit(1.0)).otherwise(F.lit(0.0)) - _c(p)
    return F.avg(d * d)


def base_rate_log_loss(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Log loss of always predicting the observed share."""
    r = F.avg(F.col(y).cast("double"))
    g = df.groupBy(*by).agg(r.alias("_r"))
    q = clamp("_r", 1e-6, 1 - 1e-6)
    return g.withColumn("base_log_loss", -(F.col("_r") * F.log(q) + (1 - F.col("_r")) * F.log(1 - q))).drop("_r")


def calibration_table(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins (a, b], the first one closed below."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"),
        F.avg(F.col(y).cast("double")).alias("actual"),
    ).withColumn("gap", F.col("actual") - F.col("mean_pred"))


def bucket_label(x, edges: Sequence[float]) -> Column:
    """[a, b) buckets, the last one open."""
    x = _c(x)
    out = None
    for lo, hi in zip(edges, list(edges[1:]) + [None]):
        label = f"{lo:g}-{hi:g}" if hi is not None else f"{lo:g}+"
        cond = (x >= lo) if hi is None else (x >= lo) & (x < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def leader_probability(margin) -> Column:
    m = _c(margin)
    return F.when(m > 0, 0.99).when(m < 0, 0.01).otherwise(0.5)


def axis_half_width(values: Sequence[Column], headroom: float = 1.15) -> Column:
    """Half width of a chart window: largest deviation from the mean with headroom, up to a half."""
    return F.ceil(F.greatest(*values) * headroom * 2) / 2


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Two independently made tables side by side: keys, each measure of both, the largest gap and why a row doesn't agree.

    A full outer join (NULL keys are equal), so a row that only one side has is shown and not lost.
    """
    c = F.col
    named = right.select(*[c(k).alias(f"_{k}") for k in keys], *[c(m).alias(f"{m}_other") for m in measures], F.lit(True).alias("_right"))
    both = left.select(*keys, *measures, F.lit(True).alias("_left")).join(named, [c(k).eqNullSafe(c(f"_{k}")) for k in keys], "full")
    gaps = {m: F.abs(c(m) - c(f"{m}_other")) for m in measures}
    far = lambda m: F.coalesce(gaps[m] > tolerance, c(m).isNotNull() | c(f"{m}_other").isNotNull())
    differing = F.array_join(F.array_compact(F.array(*[F.when(far(m), F.lit(m)) for m in measures])), ", ")
    reason = (
        F.when(c("_right").isNull(), "first only").when(c("_left").isNull(), "second only")
        .when(differing != "", F.concat(F.lit("differs: "), differing)).otherwise("agrees")
    )
    return both.select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys], *measures, *[f"{m}_other" for m in measures],
        F.greatest(*gaps.values(), F.lit(0.0)).alias("gap"), reason.alias("reason"),
    )
