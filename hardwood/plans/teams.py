"""Team efficiency tables, four-factor strip and weight fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.metrics import (
    efg, pro_game_minutes, ratio, rebound_share, turnover_share_of_used, with_team_metrics,
)
from hardwood.operators.aggregates import aggregate_games, last_n, leave_one_out_mean
from hardwood.operators.filters import clean_player_box, drop_nonstandard, season_type_filter
from hardwood.operators.pairing import pair_opponents, pair_two_sided
from hardwood.operators.reshape import keep_first, to_long
from hardwood.schemas import BOX_COUNTS

TEAM_TOTALS = {
    "minutes": "minutes", "fgm": "fgm", "fga": "fga", "fg3m": "fg3m", "fg3a": "fg3a", "ftm": "ftm",
    "fta": "fta", "oreb": "oreb", "dreb": "dreb", "reb": "reb", "tov": "tov", "pts": "pts",
}

# Strip metrics and whether higher is better.
STRIP_METRICS = {
    "efg": True, "tov_pct": False, "oreb_pct": True, "ft_rate": True,
    "opp_efg": False, "opp_tov_pct": True, "dreb_pct": True, "opp_ft_rate": False,
}


def game_lengths(schedule: DataFrame) -> DataFrame:
    """One row per game with its length in minutes."""
    return keep_first(
        schedule.select("game_id", "status_period"), ["game_id"], ["status_period"]
    ).select("game_id", pro_game_minutes("status_period").alias("game_minutes"))


def team_games(
    team_box: DataFrame, schedule: DataFrame | None = None, season_type: str = "regular",
    standard_only: bool = False, patterns: Sequence[str] = (), seasons: Sequence[int] | None = None,
    carry: Sequence[str] = ("season", "game_date", "team_home_away"),
) -> DataFrame:
    """Paired team games with every metric; lengths (and so pace) when a schedule is given."""
    box = season_type_filter(team_box, season_type)
    if seasons is not None:
        box = box.where(F.col("season").isin(list(seasons)))
    if standard_only:
        box = drop_nonstandard(box, schedule, patterns)
    games = pair_two_sided(box, carry=carry)
    if schedule is not None:
        games = games.join(game_lengths(schedule), "game_id", "left")
    return with_team_metrics(games)


def team_efficiency(paired: DataFrame, *by: str, estimator: str = "oliver") -> DataFrame:
    return aggregate_games(paired, *by, estimator=estimator)


def recent_efficiency(paired: DataFrame, n: int, first: bool = False) -> DataFrame:
    """Efficiency over each team's latest (or first) n games of a season."""
    d = F.col("game_date").asc() if first else F.col("game_date").desc()
    return aggregate_games(last_n(paired, ["season", "team_id"], n, [d, F.col("game_id")]), "season", "team_id")


def player_team_games(player_box: DataFrame, honour_dnp: bool = True) -> DataFrame:
    """Team-game totals from player rows."""
    return clean_player_box(player_box, honour_dnp).groupBy("season", "game_id", "team_id").agg(
        *[F.sum(src).alias(f"team_{name}") for name, src in TEAM_TOTALS.items()]
    )


def team_totals(player_box: DataFrame, honour_dnp: bool = True, game: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(team game, team game with opponent, team season) from player rows, or from their team games where these are at hand."""
    game = player_team_games(player_box, honour_dnp) if game is None else game
    paired = pair_opponents(
        game, ["season", "game_id"], "team_id", [f"team_{n}" for n in TEAM_TOTALS]
    )
    season = paired.groupBy("season", "team_id").agg(
        *[F.sum(f"team_{n}").alias(f"team_{n}_total") for n in TEAM_TOTALS],
        *[F.sum(f"opp_team_{n}").alias(f"opp_{n}_total") for n in TEAM_TOTALS],
    )
    return game, paired, season


def strip_factors(team_season: DataFrame) -> DataFrame:
    t, o = (lambda n: f"team_{n}_total"), (lambda n: f"opp_{n}_total")
    return team_season.withColumns({
        "efg": efg(t("fgm"), t("fg3m"), t("fga")),
        "tov_pct": turnover_share_of_used(t("fga"), t("fta"), t("tov")),
        "oreb_pct": rebound_share(t("oreb"), o("dreb")),
        "ft_rate": ratio(t("fta"), t("fga")),
        "opp_efg": efg(o("fgm"), o("fg3m"), o("fga")),
        "opp_tov_pct": turnover_share_of_used(o("fga"), o("fta"), o("tov")),
        "dreb_pct": rebound_share(t("dreb"), o("oreb")),
        "opp_ft_rate": ratio(o("fta"), o("fga")),
    })


def four_factor_strip(team_season: DataFrame, conference: DataFrame) -> DataFrame:
    """Every team against the rest of its conference, one row per metric, ranked best first.

    `conference` maps team_id to conf. Groups are conferences of one season: a few dozen teams.
    """
    wide = strip_factors(team_season).join(conference.select("team_id", "conf"), "team_id")
    long = to_long(wide, ["season", "conf", "team_id"], list(STRIP_METRICS))
    long = leave_one_out_mean(long, ["season", "conf", "metric"], "value", "conf_others_avg")
    better = F.col("metric").isin([m for m, up in STRIP_METRICS.items() if up])
    key = F.when(better, F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("season", "conf", "metric").orderBy(key.desc(), F.col("team_id"))
    return (
        long.where(F.col("value").isNotNull())
        .withColumn("higher_better", better)
        .withColumn("metric_rank", F.row_number().over(w))
    )


def four_factor_rows(player_box: DataFrame) -> DataFrame:
    """Team-game rows with net rating and four factors on simple possessions."""
    _, paired, _ = team_totals(player_box)
    renamed = paired.select(
        "season", "game_id", "team_id",
        *[F.col(f"team_{c}").alias(c) for c in BOX_COUNTS],
        *[F.col(f"opp_team_{c}").alias(f"opp_{c}") for c in BOX_COUNTS],
    )
    m = with_team_metrics(renamed, estimator="simple")
    return m.select("season", "game_id", "team_id", "net_rtg", "efg", "tov_pct", "orb_pct", "ft_rate").dropna()


def fit_four_factor_weights(rows: DataFrame):
    """Ordinary least squares of net rating on the four factors (exact normal equations)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = ["efg", "tov_pct", "orb_pct", "ft_rate"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return LinearRegression(
        featuresCol="features", labelCol="net_rtg", solver="normal", regParam=0.0
    ).fit(data), names


def four_factor_moments(rows: DataFrame) -> DataFrame:
    """Sums and cross products of the OLS fit: its sufficient statistics in one aggregation."""
    names = ["efg", "tov_pct", "orb_pct", "ft_rate", "net_rtg"]
    terms = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s_{c}") for c in names]
    for i, a in enumerate(names):
        terms += [F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for b in names[i:]]
    return rows.agg(*terms)


def four_factor_weights(rows: DataFrame) -> DataFrame:
    """term, weight, r2, rmse of the least-squares fit, solved in the plan from the one row of moments.

    The centred normal equations are eliminated column by column; each step is a projection of that row.
    """
    x, y = ["efg", "tov_pct", "orb_pct", "ft_rate"], "net_rtg"
    names, c = [*x, y], F.col
    m = four_factor_moments(rows)
    m = m.select(
        "n", *[(c(f"s_{a}") / c("n")).alias(f"mean_{a}") for a in names],
        *[(c(f"x_{a}_{b}") - c(f"s_{a}") * c(f"s_{b}") / c("n")).alias(f"{a}:{b}") for i, a in enumerate(names) for b in names[i:]],
    ).withColumn("total", c(f"{y}:{y}"))
    for k, a in enumerate(x):  # what is left of b and d after the part that a explains
        m = m.withColumns({
            f"{b}:{d}": c(f"{b}:{d}") - c(f"{a}:{b}") * c(f"{a}:{d}") / c(f"{a}:{a}")
            for i, b in enumerate(names[k + 1 :], k + 1) for d in names[i:]
        })
    for k in range(len(x) - 1, -1, -1):
        a = x[k]
        later = sum((c(f"{a}:{d}") * c(f"w_{d}") for d in x[k + 1 :]), F.lit(0.0))
        m = m.withColumn(f"w_{a}", (c(f"{a}:{y}") - later) / c(f"{a}:{a}"))
    intercept = c(f"mean_{y}") - sum((c(f"w_{a}") * c(f"mean_{a}") for a in x), F.lit(0.0))
    left = c(f"{y}:{y}")
    terms = F.array(*[F.struct(F.lit(t).alias("term"), w.alias("weight")) for t, w in [("intercept", intercept), *[(a, c(f"w_{a}")) for a in x]]])
    return m.select(F.inline(terms), (1 - left / c("total")).alias("r2"), F.sqrt(left / c("n")).alias("rmse"))
