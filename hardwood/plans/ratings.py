"""As-of opponent-adjusted team ratings.

Games enter the solves only as sums: every game adds a few entries to the normal equations of its
date, and those are aggregated before anything else. What is then solved is bounded by teams
squared per date, whatever the number of games. Dates are cut into months; a month starts from the
summed entries of earlier months, so months and parameter cells run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.metrics import expected_spread, net_per_100, simple_possessions
from hardwood.operators.aggregates import regression_scores
from hardwood.operators.quantiles import exact_quantiles
from hardwood.schemas import CARRYOVER_DECAY, DEFAULT_PACE, HOME_TERM_EPS, LEAGUE_RULES, MIN_PACE_GAMES, RATING_LAMBDA
from hardwood.session import materialize

HOME, NEUTRAL, TARGET = "_home", "_neutral", "_y"
RATING_DDL = (
    "season int, date date, team string, rating double, n_games int, home_term double, "
    "neutral_term double, method string, lambda double, decay double"
)


def game_frame(team_box: DataFrame, schedule: DataFrame | None = None, pace_floor: float = 20.0) -> DataFrame:
    """One row per well-formed game: sides, pace, home net per 100, neutral flag."""
    c = F.col
    home = lambda x: F.max(F.when(c("team_home_away") == "home", c(x)))
    away = lambda x: F.max(F.when(c("team_home_away") == "away", c(x)))
    g = (
        team_box.where(c("pts").isNotNull()).withColumn("_p", simple_possessions()).groupBy("game_id")
        .agg(
            F.max("season").alias("season"), F.max("game_date").alias("date"), F.count(F.lit(1)).alias("_n"),
            F.count("_p").alias("_k"), (F.sum("_p") / 2).alias("pace"), home("team_id").alias("home"),
            away("team_id").alias("away"), home("pts").alias("home_final"), away("pts").alias("away_final"),
        )
        .where((c("_n") == 2) & (c("_k") == 2) & (c("pace") > pace_floor) & (c("home") != c("away")))
        .drop("_n", "_k").withColumn("home_net", net_per_100("home_final", "away_final", "pace"))
    )
    if schedule is None:
        return g.withColumn("neutral", F.lit(False))
    ns = schedule.groupBy("game_id").agg(F.bool_or("neutral_site").alias("neutral"))
    return g.join(ns, "game_id", "left").withColumn("neutral", F.coalesce("neutral", F.lit(False)))


def by_league(games: DataFrame) -> DataFrame:
    """Games of several leagues (column `league`) with seasons and teams that no other league has, for the ratings.

    Leagues share team names. The season becomes 10000 * the league's number + season, the team is preceded by the league.
    """
    number = F.create_map(*[x for i, k in enumerate(LEAGUE_RULES, 1) for x in (F.lit(k), F.lit(i))])[F.col("league")]
    own = lambda team: F.concat_ws(":", "league", team)
    return games.withColumns({"season": (number * 10_000 + F.col("season")).cast("int"), "home": own("home"), "away": own("away")})


def team_days(games: DataFrame) -> DataFrame:
    """Games and summed net per season, team and date."""
    side = lambda team, sign: F.struct(F.col(team).alias("team"), (F.lit(sign) * F.col("home_net")).alias("net"))
    return games.select("season", "date", F.inline(F.array(side("home", 1.0), side("away", -1.0)))).groupBy(
        "season", "team", "date"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("net"))


def site_terms(games: DataFrame) -> DataFrame:
    """Mean home net before each date, at home courts and at neutral ones."""
    c = F.col
    day = games.groupBy("season", "date").agg(*[
        a for site, cond in (("home", ~c("neutral")), ("neutral", c("neutral")))
        for a in (F.sum(F.when(cond, 1).otherwise(0)).alias(f"{site}_n"), F.sum(F.when(cond, c("home_net")).otherwise(0.0)).alias(f"{site}_s"))
    ])
    w = Window.partitionBy("season").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    term = lambda s: F.when(F.sum(f"{s}_n").over(w) > 0, F.sum(f"{s}_s").over(w) / F.sum(f"{s}_n").over(w)).otherwise(0.0)
    return day.select("season", "date", term("home").alias("home_term"), term("neutral").alias("neutral_term"))


def date_grid(games: DataFrame) -> DataFrame:
    """Every team of a season on every game date of it: the rating table's own grain."""
    dates = games.select("season", "date").distinct()
    teams = games.select("season", F.explode(F.array("home", "away")).alias("team")).distinct()
    return dates.join(teams, "season")


def _season_numbers(games: DataFrame) -> DataFrame:
    """Consecutive numbers of the seasons present (a few rows)."""
    return games.select("season").distinct().withColumn(
        "season_no", F.row_number().over(Window.orderBy("season"))
    )


def margin_ratings(games: DataFrame, lam: float = RATING_LAMBDA, decay: float = CARRYOVER_DECAY) -> DataFrame:
    """Shrunk mean net of strictly earlier games: k/(k + lambda/10) towards the carried prior."""
    c = F.col
    w = Window.partitionBy("season", "team").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    run = date_grid(games).join(team_days(games), ["season", "team", "date"], "left").select(
        "season", "team", "date",
        F.coalesce(F.sum("n").over(w), F.lit(0)).cast("int").alias("n_games"),
        F.coalesce(F.sum("net").over(w), F.lit(0.0)).alias("_s"),
    ).withColumns({
        "_w": c("n_games") / (c("n_games") + F.lit(lam / 10)),
        "_m": F.when(c("n_games") > 0, c("_s") / c("n_games")).otherwise(0.0),
    })
    # what each season ends on, folded over a team's seasons (as many entries as seasons)
    ends = run.join(_season_numbers(games), "season").groupBy("season", "season_no", "team").agg(
        F.max_by(F.struct("_w", "_m"), "date").alias("e")
    )
    step = lambda acc, x: F.struct(
        x["no"].alias("no"),
        (x["w"] * x["m"] + (F.lit(1.0) - x["w"]) * F.when(acc["no"] == x["no"] - 1, acc["r"] * decay).otherwise(0.0)).alias("r"),
    )
    history = ends.groupBy("team").agg(F.array_sort(F.collect_list(
        F.struct(c("season_no").alias("no"), c("season").alias("season"), c("e._w").alias("w"), c("e._m").alias("m"))
    )).alias("h"))
    seed = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("r"))
    priors = history.select("team", F.posexplode("h").alias("i", "x"), "h").select(
        "team", c("x.season").alias("season"), c("x.no").alias("no"),
        F.aggregate(F.slice("h", F.lit(1), c("i")), seed, step).alias("p"),
    ).select("team", "season", F.when(c("p.no") == c("no") - 1, c("p.r") * decay).otherwise(0.0).alias("_b0"))
    return (
        run.join(priors, ["season", "team"]).join(site_terms(games), ["season", "date"])
        .where((c("n_games") > 0) | (c("_b0") != 0))
        .select(
            "season", "date", "team", (c("_w") * c("_m") + (F.lit(1.0) - c("_w")) * c("_b0")).alias("rating"), "n_games",
            "home_term", "neutral_term", F.lit("margin").alias("method"), F.lit(float(lam)).alias("lambda"),
            F.lit(float(decay)).alias("decay"),
        )
    )


def normal_entries(games: DataFrame) -> DataFrame:
    """Normal-equation entries per season and date: (a, b, v) with a <= b, and (a, target, v)."""
    c = F.col
    site = F.when(c("neutral"), NEUTRAL).otherwise(HOME)

    def entry(a, b, v):
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), v.cast("double").alias("v"))

    def rhs(a, v):
        return F.struct(a.alias("a"), F.lit(TARGET).alias("b"), v.cast("double").alias("v"))

    one = F.lit(1.0)
    h, a, y = c("home"), c("away"), c("home_net")
    return games.select("season", "date", F.inline(F.array(
        entry(h, h, one), entry(a, a, one), entry(h, a, -one), entry(h, site, one), entry(a, site, -one), entry(site, site, one),
        rhs(h, y), rhs(a, -y), rhs(site, y),
    ))).groupBy("season", "date", "a", "b").agg(F.sum("v").alias("v"))


class _System:
    """Dense normal equations over one season's names."""

    def __init__(self, names):
        self.names = sorted(names) + [HOME, NEUTRAL]
        self.at = {n: i for i, n in enumerate(self.names)}
        p = len(self.names)
        self.xtx, self.xty = np.zeros((p, p)), np.zeros(p)

    def add(self, a, b, v) -> None:
        i = np.fromiter((self.at[x] for x in a), dtype=int, count=len(a))
        rhs = np.asarray(b == TARGET)
        np.add.at(self.xty, i[rhs], v[rhs])
        i, w = i[~rhs], v[~rhs]
        j = np.fromiter((self.at[x] for x in b[~rhs]), dtype=int, count=len(i))
        np.add.at(self.xtx, (i, j), w)
        off = i != j
        np.add.at(self.xtx, (j[off], i[off]), w[off])

    def solve(self, lam: float, priors: np.ndarray) -> np.ndarray:
        """One column of coefficients per prior column."""
        pen = np.full(len(self.names), float(lam))
        pen[-2:] = HOME_TERM_EPS
        return np.linalg.solve(self.xtx + np.diag(pen), self.xty[:, None] + pen[:, None] * priors)


def _names(a: pd.Series, b: pd.Series) -> set:
    return (set(a) | set(b)) - {HOME, NEUTRAL, TARGET}


def _chain_priors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Carried priors of one (lambda, decay) cell, season after season, from each season's last table."""
    lam, decay = float(pdf["lambda"].iloc[0]), float(pdf["decay"].iloc[0])
    prior, out = {}, []
    for season, g in pdf.sort_values("season").groupby("season", sort=True):
        members = _names(g["a"], g["b"])
        known = {t: r for t, r in prior.items() if t in members}
        out += [(int(season), t, r, lam, decay) for t, r in known.items() if r != 0]
        s = _System(members)
        live = g[g["v"].notna()]
        s.add(live["a"].to_numpy(), live["b"].to_numpy(), live["v"].to_numpy())
        b0 = np.array([[known.get(n, 0.0)] for n in s.names])
        beta = s.solve(lam, b0)[:, 0]
        played = np.diag(s.xtx)
        prior = {
            n: beta[i] * decay for i, n in enumerate(s.names[:-2]) if played[i] > 0 or b0[i, 0] != 0
        } if decay > 0 else {}
    return pd.DataFrame(out, columns=["season", "team", "b0", "lambda", "decay"])


def _solve_month(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every date of one season month for one lambda; all decays share a factorisation."""
    season, lam = int(pdf["season"].iloc[0]), float(pdf["lambda"].iloc[0])
    prior = pdf[pdf["kind"] == "prior"]
    decays = sorted(pdf.loc[pdf["kind"] == "cell", "decay"].unique())
    entries = pdf[pdf["kind"].isin(["base", "day"])]
    s = _System(_names(entries["a"], entries["b"]) | set(prior["a"]))
    b0 = np.zeros((len(s.names), len(decays)))
    for t, d, v in zip(prior["a"], prior["decay"], prior["v"]):
        b0[s.at[t], decays.index(d)] = v
    base = entries[entries["kind"] == "base"]
    s.add(base["a"].to_numpy(), base["b"].to_numpy(), base["v"].to_numpy())
    teams = np.array(s.names[:-2], dtype=object)
    frames = []
    for date, day in entries[entries["kind"] == "day"].groupby("date", sort=True):
        beta = s.solve(lam, b0)
        played = np.rint(np.diag(s.xtx)[:-2]).astype(int)
        for k, d in enumerate(decays):
            keep = (played > 0) | (b0[:-2, k] != 0)
            frames.append(pd.DataFrame({
                "season": season, "date": date, "team": teams[keep], "rating": beta[:-2, k][keep], "n_games": played[keep],
                "home_term": beta[-2, k], "neutral_term": beta[-1, k], "method": "adjusted", "lambda": lam, "decay": float(d),
            }))
        s.add(day["a"].to_numpy(), day["b"].to_numpy(), day["v"].to_numpy())
    cols = ["season", "date", "team", "rating", "n_games", "home_term", "neutral_term", "method", "lambda", "decay"]
    return pd.concat(frames, ignore_index=True)[cols] if frames else pd.DataFrame(columns=cols)


def _cells(pairs: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("lambda"), F.lit(float(d)).alias("decay")) for a, d in pairs])


def ridge_ratings(
    games: DataFrame, cells: Sequence[tuple[float, float]] = ((RATING_LAMBDA, CARRYOVER_DECAY),),
) -> DataFrame:
    """Rating table of every (lambda, decay) cell: strictly earlier games, ridge towards the prior.

    The prior is the previous season's last table times decay, so a season's last-day games never
    enter it and a team that skips a season loses it.
    """
    c = F.col
    entries = normal_entries(games)
    last = games.groupBy("season").agg(F.max("date").alias("_last"))
    # entries on the last date only name teams there; they are not in that date's own table
    ends = entries.join(F.broadcast(last), "season").groupBy("season", "a", "b").agg(
        F.sum(F.when(c("date") < c("_last"), c("v"))).alias("v")
    )
    priors = ends.select("*", F.inline(_cells(cells))).groupBy("lambda", "decay").applyInPandas(
        _chain_priors, "season int, team string, b0 double, lambda double, decay double"
    )
    month = (F.year("date") * 12 + F.month("date")).alias("month")
    monthly = entries.groupBy("season", month, "a", "b").agg(F.sum("v").alias("v"))
    months = entries.select("season", month).distinct()
    base = monthly.withColumnRenamed("month", "_from").join(F.broadcast(months), "season").where(
        c("_from") < c("month")
    ).groupBy("season", "month", "a", "b").agg(F.sum("v").alias("v"))
    lams = F.array(*[F.lit(x) for x in sorted({float(a) for a, _ in cells})])
    no_date, no_name, no_num = F.lit(None).cast("date"), F.lit(None).cast("string"), F.lit(None).cast("double")

    def rows(df, kind, date=no_date, decay=no_num):
        return df.select("season", "month", F.lit(kind).alias("kind"), date.alias("date"), "a", "b", "v", "lambda", decay.alias("decay"))

    spread = lambda df: df.withColumn("lambda", F.explode(lams))
    prior_rows = priors.join(months, "season").select(
        "season", "month", c("team").alias("a"), no_name.alias("b"), c("b0").alias("v"), "lambda", "decay"
    )
    cell_rows = months.select("season", "month", no_name.alias("a"), no_name.alias("b"), no_num.alias("v"), F.inline(_cells(cells)))
    work = (
        rows(spread(base), "base").unionByName(rows(spread(entries.withColumn("month", F.year("date") * 12 + F.month("date"))), "day", c("date")))
        .unionByName(rows(prior_rows, "prior", decay=c("decay"))).unionByName(rows(cell_rows, "cell", decay=c("decay")))
    )
    return work.groupBy("season", "month", "lambda").applyInPandas(_solve_month, RATING_DDL)


def ratings_on(games: DataFrame, date, method: str = "adjusted", lam: float = RATING_LAMBDA) -> DataFrame:
    """Ratings before one date without any prior; not meant for scoring."""
    earlier = games.where(F.col("date") < F.lit(date).cast("date")).withColumn("season", F.lit(0))
    if method == "margin":
        days = team_days(earlier).groupBy("team").agg(F.sum("n").cast("int").alias("n_games"), F.sum("net").alias("_s"))
        n = F.col("n_games")
        return days.select("team", (F.col("_s") / n * (n / (n + F.lit(lam / 10)))).alias("rating"), "n_games")
    entries = materialize(normal_entries(earlier).groupBy("a", "b").agg(F.sum("v").alias("v")))
    played = entries.where("a = b").select(F.col("a").alias("name"), F.round("v").cast("int").alias("n_games"))
    solved = ridge_solve(entries, lam).join(played, "name").where(~F.col("name").isin(HOME, NEUTRAL))
    return solved.select(F.col("name").alias("team"), F.col("x").alias("rating"), "n_games")


def penalised(entries: DataFrame, lam: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, v) of the whole symmetric matrix with its penalties, and (name, y, d): right-hand side and diagonal."""
    c = F.col
    pen = lambda x: F.when(c(x).isin(HOME, NEUTRAL), F.lit(HOME_TERM_EPS)).otherwise(F.lit(float(lam)))
    inner = entries.where(c("b") != TARGET)
    matrix = inner.select("a", "b", F.when(c("a") == c("b"), c("v") + pen("a")).otherwise(c("v")).alias("v")).unionByName(
        inner.where("a <> b").select(c("b").alias("a"), c("a").alias("b"), "v")
    )
    sides = entries.where(c("b") == TARGET).select(c("a").alias("name"), c("v").alias("y"))
    diagonal = matrix.where("a = b").select(c("a").alias("name"), c("v").alias("d"))
    return matrix, diagonal.join(sides, "name", "left").fillna(0.0, ["y"])


def ridge_solve(entries: DataFrame, lam: float = RATING_LAMBDA, tolerance: float = 1e-11, rounds: int = 500) -> DataFrame:
    """name, x: the penalised normal equations solved by conjugate gradients over the stored sparse entries.

    A round is one join of the entries with the direction and one small aggregate; only sums come to the driver, and no task
    holds a matrix. The diagonal scales the residuals. Ends when the scaled residual is `tolerance` of the first.
    """
    matrix, sides = penalised(entries, lam)
    matrix = materialize(matrix)
    c, r, q, d = F.col, F.col("r"), F.col("q"), F.col("d")

    def with_product(state: DataFrame) -> DataFrame:
        product = matrix.join(state.select(c("name").alias("b"), c("p").alias("_p")), "b").groupBy(c("a").alias("name")).agg(F.sum(c("v") * c("_p")).alias("q"))
        return materialize(state.join(product, "name"))

    state = with_product(sides.select("name", "d", F.lit(0.0).alias("x"), c("y").alias("r"), (c("y") / d).alias("p")))
    first = None
    for _ in range(rounds):
        s = state.agg(
            F.sum(r * r / d).alias("rr"), F.sum(c("p") * q).alias("pq"), F.sum(r * q / d).alias("rq"), F.sum(q * q / d).alias("qq")
        ).first()
        if s.rr is None or s.rr == 0 or (first is not None and s.rr <= tolerance**2 * first):
            break
        first = s.rr if first is None else first
        step = s.rr / s.pq
        rr = max(0.0, s.rr - 2 * step * s.rq + step * step * s.qq)
        state = with_product(state.select(
            "name", "d", (c("x") + step * c("p")).alias("x"), (r - step * q).alias("r"), ((r - step * q) / d + rr / s.rr * c("p")).alias("p")
        ))
    return state.select("name", "x")


def ridge_residual(entries: DataFrame, solution: DataFrame, lam: float = RATING_LAMBDA) -> DataFrame:
    """name, residual of the penalised normal equations at (name, x)."""
    matrix, sides = penalised(entries, lam)
    c = F.col
    product = matrix.join(solution.select(c("name").alias("b"), "x"), "b").groupBy(c("a").alias("name")).agg(F.sum(c("v") * c("x")).alias("_ax"))
    return sides.join(product, "name", "left").select("name", (c("y") - F.coalesce("_ax", F.lit(0.0))).alias("residual"))


def attach_ratings(games: DataFrame, ratings: DataFrame, params: Sequence[str] = ()) -> DataFrame:
    """Both sides' ratings at the game date and the expected margin; unrated reads as zero."""
    c = F.col
    keys = ["season", "date"]
    home = ratings.select(*keys, *params, c("team").alias("home"), c("rating").alias("r_home"), c("n_games").alias("n_home"), "home_term", "neutral_term")
    away = ratings.select(*keys, *params, c("team").alias("away"), c("rating").alias("r_away"), c("n_games").alias("n_away"))
    out = games.join(home, [*keys, "home"], "left").join(away, [*keys, *params, "away"], "left")
    out = out.fillna(0.0, ["r_home", "r_away", "home_term", "neutral_term"]).fillna(0, ["n_home", "n_away"])
    term = F.when(c("neutral"), c("neutral_term")).otherwise(c("home_term"))
    return out.withColumns({
        "spread_home": expected_spread("r_home", "r_away", term, "pace"),
        "actual": c("home_net") * c("pace") / 100,
    })


def method_report(games: DataFrame, ratings: DataFrame, by: Sequence[str] = ("method", "lambda", "decay"), extra: Sequence[Column] = ()) -> DataFrame:
    """Accuracy of the expected margin where both teams have an earlier game."""
    scored = attach_ratings(games, ratings, [b for b in by if b in ratings.columns]).where(
        (F.col("n_home") >= 1) & (F.col("n_away") >= 1)
    )
    return scored.groupBy(*by, *extra).agg(*regression_scores("actual", "spread_home"))


def tune_holdout(games: DataFrame, cells: Sequence[tuple[float, float]], holdout: Sequence[int], rate: Callable[[DataFrame, float, float], DataFrame]) -> DataFrame:
    """Scores of each (lambda, decay) cell on tuning and on held-out seasons, and the chosen cell by month and season.

    `rate(games, lambda, decay)` makes a rating table. Only tuning seasons choose (least error, then smaller values). One row per
    level (cell, month, season), split and part: lambda, decay, part, n, rmse, cor, calib_slope, chosen.
    """
    c = F.col
    scored = None
    for lam, decay in cells:
        one = attach_ratings(games, rate(games, lam, decay)).where("n_home >= 1 AND n_away >= 1").select(
            F.lit(float(lam)).alias("lambda"), F.lit(float(decay)).alias("decay"), "season", F.month("date").alias("month"), "actual", "spread_home",
            F.when(c("season").isin(list(holdout)), "holdout").otherwise("tune").alias("split"),
        )
        scored = one if scored is None else scored.unionByName(one)
    scored = materialize(scored)
    scores = regression_scores("actual", "spread_home")
    by_cell = materialize(scored.groupBy("split", "lambda", "decay").agg(*scores))
    best = by_cell.where("split = 'tune'").agg(F.min_by(F.struct("lambda", "decay"), F.struct("rmse", "lambda", "decay")).alias("b")).select("b.*")
    mine = scored.join(F.broadcast(best), ["lambda", "decay"])
    level = lambda df, name, part: df.select(F.lit(name).alias("level"), "split", "lambda", "decay", part.cast("int").alias("part"), "n", "rmse", "cor", "calib_slope")
    out = level(by_cell, "cell", F.lit(None))
    for name in ("month", "season"):
        out = out.unionByName(level(mine.groupBy("split", "lambda", "decay", name).agg(*scores), name, c(name)))
    chosen = best.select("lambda", "decay", F.lit(True).alias("_chosen"))
    return out.join(F.broadcast(chosen), ["lambda", "decay"], "left").withColumn("chosen", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def spread_quantiles(scored: DataFrame, at: Sequence[float] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """Exact quantiles of all spreads; no task holds them all."""
    return exact_quantiles(scored, {f"p{int(q * 100):02d}": ("spread_home", q) for q in at}, [], ["game_id"])



def table_dates(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """date, table_date: the last date of the rating table on or before each requested date. Dates are a calendar's worth of rows."""
    c = F.col
    known = ratings.select("date").distinct().select("date", c("date").alias("table_date"), F.lit(0).alias("_ask"))
    asked = requests.select("date").distinct().select("date", F.lit(None).cast("date").alias("table_date"), F.lit(1).alias("_ask"))
    w = Window.orderBy("date", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked).withColumn("table_date", F.last("table_date", ignorenulls=True).over(w))
    return both.where(c("_ask") == 1).select("date", "table_date")


def matchup_pace(home, away, default: float = DEFAULT_PACE) -> Column:
    """Mean of two teams' paces to one decimal; the default where one is unknown."""
    mean = (F.col(home) + F.col(away)) / 2
    return F.coalesce(F.bround(F.round(mean, 8), 1), F.lit(default))


def matchup_spreads(
    requests: DataFrame, ratings: DataFrame, paces: DataFrame | None = None, neutral_mode: str = "zero", pace: float = DEFAULT_PACE,
) -> DataFrame:
    """Spread of requested games (request_id, date, home, away, neutral) from one date of the table for both sides and the site.

    A team that the table doesn't rate on that date gives no spread but a reason. `paces` has a pace for each team.
    """
    c = F.col
    asked = requests.join(table_dates(requests, ratings), "date", "left")
    side = lambda name, cols: ratings.select(
        c("date").alias("table_date"), c("team").alias(name), c("rating").alias(f"r_{name}"), *[c(x) for x in cols]
    )
    out = asked.join(side("home", ["home_term", "neutral_term"]), ["table_date", "home"], "left").join(
        side("away", []), ["table_date", "away"], "left"
    )
    if paces is None:
        out = out.withColumn("pace", F.lit(pace))
    else:
        one = lambda name: paces.select(c("team").alias(name), c("pace").alias(f"_p_{name}"))
        out = out.join(one("home"), "home", "left").join(one("away"), "away", "left")
        out = out.withColumn("pace", matchup_pace("_p_home", "_p_away", pace)).drop("_p_home", "_p_away")
    at_neutral = c("neutral_term") if neutral_mode == "term" else F.lit(0.0)
    term = F.when(c("neutral"), at_neutral).otherwise(c("home_term"))
    reason = F.when(c("table_date").isNull(), "no table yet").when(c("r_home").isNull(), "home team not rated").when(c("r_away").isNull(), "away team not rated")
    return out.withColumns({"spread_home": expected_spread("r_home", "r_away", term, "pace"), "reason": reason})


def team_pace(games: DataFrame, min_games: int = MIN_PACE_GAMES) -> DataFrame:
    return games.select(F.explode(F.array("home", "away")).alias("team"), "pace").groupBy("team").agg(
        # eight decimals first, so that summation order cannot move a rounding tie
        F.round(F.avg("pace"), 8).alias("pace"), F.count(F.lit(1)).alias("pace_games")
    ).where(F.col("pace_games") >= min_games)


def rating_board(ratings: DataFrame, games: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Serving snapshot: the last date's ratings with pace (default when too few games)."""
    last = ratings.agg(F.max("date").alias("date"))
    season = games.agg(F.max("season").alias("season"))
    pace = team_pace(games.join(F.broadcast(season), "season"))
    out = ratings.join(F.broadcast(last), "date").join(pace, "team", "left").withColumn(
        "pace", F.coalesce(F.bround("pace", 1), F.lit(DEFAULT_PACE))
    )
    return out if names is None else out.join(names, "team", "left")
