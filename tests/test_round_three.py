"""Solvers, quantiles, reconciliation, filling and populations against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators.aggregates import reconcile
from hardwood.operators.quantiles import exact_quantiles
from hardwood.plans import fill
from hardwood.plans import lineups as LU
from hardwood.plans import ratings as RT
from hardwood.plans import season as SE


def test_exact_quantiles_with_ties_nulls_and_nans(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.integers(0, 9)) if i % 7 else None, float(rng.normal())) for g in ("a", "b", None) for i in range(1 if g == "b" else 101)]
    rows += [("a", 1000, float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    out = exact_quantiles(df, {"m": ("x", 0.5), "lo": ("x", 0.1), "y9": ("y", 0.9)}, ["g"], ["id"])
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in out.collect()}
    for g in ("a", None):
        x = [r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]]
        y = [r[3] for r in rows if r[0] == g]
        assert np.allclose([got[g].m, got[g].lo, got[g].y9], [np.quantile(x, 0.5), np.quantile(x, 0.1), np.quantile(y, 0.9)])
    assert got["b"].m is None and np.isclose(got["b"].y9, next(r[3] for r in rows if r[0] == "b"))
    whole = exact_quantiles(df, {"p50": ("y", 0.5)}, [], ["g", "id"]).first()
    assert np.isclose(whole.p50, np.quantile([r[3] for r in rows], 0.5))


def test_conjugate_gradients_equal_a_dense_solve(spark):
    rng = np.random.default_rng(2)
    teams = [f"t{i}" for i in range(12)]
    games = []
    for _ in range(150):
        h, a = rng.choice(12, 2, replace=False)
        games.append((teams[h], teams[a], bool(rng.random() < 0.2), float(rng.normal(3, 10))))
    df = spark.createDataFrame(games, "home string, away string, neutral boolean, home_net double")
    df = df.withColumns({"season": F.lit(0), "date": F.to_date(F.lit("2001-01-01"))})
    entries = RT.normal_entries(df).groupBy("a", "b").agg(F.sum("v").alias("v")).cache()
    got = {r.name: r.x for r in RT.ridge_solve(entries, 3.0).collect()}
    names = [*teams, RT.HOME, RT.NEUTRAL]
    x = np.zeros((len(games), len(names)))
    for i, (h, a, neutral, _) in enumerate(games):
        x[i, names.index(h)], x[i, names.index(a)], x[i, 13 if neutral else 12] = 1, -1, 1
    pen = np.diag([3.0] * 12 + [RT.HOME_TERM_EPS] * 2)
    want = np.linalg.solve(x.T @ x + pen, x.T @ np.array([g[3] for g in games]))
    assert np.allclose([got[n] for n in names], want, atol=1e-7)
    left = RT.ridge_residual(entries, spark.createDataFrame(list(got.items()), "name string, x double"), 3.0)
    assert max(abs(r.residual) for r in left.collect()) < 1e-6
    wrong = spark.createDataFrame([(n, v + (n == "t3")) for n, v in got.items()], "name string, x double")
    assert max(abs(r.residual) for r in RT.ridge_residual(entries, wrong, 3.0).collect()) > 1


def test_reconcile_shows_a_planted_gap(spark):
    a = spark.createDataFrame([("x", 1.0, 5), ("y", 2.0, 5), ("only", 1.0, 1), (None, 3.0, 2), ("n", None, 1)], "k string, pts double, games int")
    b = spark.createDataFrame([("x", 1.0, 5), ("y", 2.5, 5), ("other", 1.0, 1), (None, 3.0, 2), ("n", 4.0, 1)], "k string, pts double, games int")
    got = {r.k: r.reason for r in reconcile(a, b, ["k"], ["pts", "games"]).collect()}
    assert got == {"x": "agrees", "y": "differs: pts", "only": "first only", "other": "second only", None: "agrees", "n": "differs: pts"}


def test_fill_resumes_and_keeps_failures_apart(spark, tables, tmp_path):
    folder = str(tmp_path / "filled")
    ids = [r.game_id for r in tables.event_schedule.select("game_id").orderBy("game_id").limit(3).collect()]
    want = spark.createDataFrame([(i,) for i in [*ids, "none"]], "game_id string")
    few = spark.createDataFrame([(ids[0],)], "game_id string")
    one = fill.fill(tables.pbp, tables.starters, few, folder)
    assert {(r.game_id, r.run) for r in one.collect()} == {(ids[0], 1)} and one.count() == 2
    two = fill.fill(tables.pbp, tables.starters, want, folder)
    assert {r.game_id for r in two.collect()} == {*ids[1:], "none"}
    assert fill.fill(tables.pbp, tables.starters, want, folder).count() == 0
    book = fill.ledger(spark, folder)
    assert {(r.table_name, r.reason) for r in book.where("NOT ok AND game_id = 'none'").collect()} == {("stints", "no events"), ("possessions", "no events")}
    # rows of a run that never wrote its ledger don't count
    fill.stored_rows(spark, folder, "possessions").write.parquet(f"{folder}/possessions/run=99")
    rows = fill.stored_rows(spark, folder, "possessions")
    counts = {r.game_id: r["count"] for r in rows.groupBy("game_id").count().collect()}
    assert counts == {r.game_id: r.n_rows for r in book.where("ok AND table_name = 'possessions'").collect()}
    report = {r.table_name: r for r in fill.fill_report(book, want).collect()}
    assert report["possessions"].requested == 4 and report["possessions"].missing == 0
    assert fill.unsettled(want, book, retry=True).count() >= 1


def test_population_errors(tables):
    with pytest.raises(LookupError, match="no team in 'atlantis'; there are: "):
        SE.resolve_population(tables.schedule, "atlantis")
    with pytest.raises(LookupError, match="no team 'zz' in the schedule"):
        SE.resolve_population(tables.schedule, "conference", "zz")


def test_lineup_search_on_a_large_pool(spark):
    """Against every combination, with bounds that prune; and no nested loop over the pool."""
    rng = np.random.default_rng(4)
    rows = [(f"p{i:04d}", ["G", "F", "C", "G-F"][i % 4], *map(float, rng.uniform(0.1, 0.3, 5))) for i in range(400)]
    pool = spark.createDataFrame(rows, "player string, position string, usage double, efg_pct double, tov_pct double, oreb_pct double, fta_rate double").cache()
    core = ["p0001", "p0002", "p0003"]
    best = LU.best_additions(pool, core, {"G": (1, 2), "F": (2, 3), "C": (1, 2)}, 5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # the one-row total of the core
    held = {r[0]: r for r in rows}
    found = []
    free = [p for p in held if p not in core]
    for i, a in enumerate(free):
        for b in free[i + 1 :]:
            five = [held[p] for p in (*core, a, b)]
            n = {p: sum(p in r[1].split("-") for r in five) for p in "GFC"}
            if not (1 <= n["G"] <= 2 and 2 <= n["F"] <= 3 and 1 <= n["C"] <= 2):
                continue
            u = sum(r[2] for r in five)
            pct = u * 100 if u < 2 else u
            stress = (pct / 100) ** 0.25
            w = LU.LINEUP_WEIGHTS
            score = (w["intercept"] + w["efg"] * sum(r[2] * r[3] for r in five) / u / stress + w["tov"] * sum(r[2] * r[4] for r in five) / u * stress
                     + w["oreb"] * sum(r[5] for r in five) / 5 + w["ftr"] * sum(r[6] for r in five) / 5)
            found.append((-round(score, 2), f"{a}, {b}"))
    want = sorted(found)[:5]
    got = [(-r.projected_net, r.added_players) for r in best.collect()]
    assert [g[0] for g in got] == pytest.approx([x[0] for x in want], abs=0.011) and len(got) == 5


def test_a_game_task_gets_a_bounded_number_of_rows_whatever_the_input(spark, monkeypatch, tmp_path):
    from hardwood import session
    from hardwood.plans import possessions as P
    from hardwood.sources.adapters import load_view

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    ev = spark.range(2000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 40 AS user_id",
        "element_at(array('purchase', 'view', 'click', 'error', 'signup'), cast(id % 5 + 1 AS int)) AS event_type", "id % 11 / 2e0 AS value",
    )
    ev.write.parquet(str(tmp_path / "events.parquet"))
    pbp = load_view(spark, str(tmp_path), "pbp")
    for df in (pbp, P.possession_rows(P.prepared_events(pbp)), P.game_states(P.possession_rows(P.prepared_events(pbp)))):
        # AQE merges small parts, but not these
        assert df.rdd.getNumPartitions() >= 20
    assert session.spread(ev.limit(0), "event_id").count() == 0


def test_running_totals_over_many_batches_shuffle_rows_once(spark):
    from hardwood.operators.percentiles import running_total

    rng = np.random.default_rng(5)
    rows = [(g, float(rng.integers(0, 4)), i, None if i % 50 == 0 else float(rng.integers(0, 5))) for i, g in enumerate(["a", "b", None, "c"] * 500)] + [("one", 1.0, -1, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, id int, w double").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = running_total(df, ["g"], ["x", F.col("id").cast("bigint")], "w")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.running, r.total) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "SortMergeJoin" not in plan and "_inside" in plan
    assert len(got) == len(rows)
    for g in ("a", "b", None, "c", "one"):
        mine = sorted((r[1], r[2], r[3] or 0.0) for r in rows if r[0] == g)
        sums = np.cumsum([m[2] for m in mine])
        assert all(got[m[1]] == (s, sums[-1]) for m, s in zip(mine, sums))


def test_season_totals_exchange_the_box_once(spark, tables):
    from hardwood.operators.filters import clean_player_box
    from hardwood.plans import players
    from hardwood.schemas import PLAYER_COUNTS
    from hardwood.session import materialize

    clean = materialize(clean_player_box(tables.player_box))
    out = players.season_totals(clean)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = [r for r in clean.collect()]
    got = {(r.season, r.athlete_id): r for r in out.collect()}
    assert got.keys() == {(r.season, r.athlete_id) for r in rows}
    for key in list(got)[:40]:
        mine = [r for r in rows if (r.season, r.athlete_id) == key]
        last = max(mine, key=lambda r: (r.game_date, r.seq, r.team_id))
        assert got[key].team_id == last.team_id and got[key].games_played == len({r.game_id for r in mine})
        assert all(got[key][f"{c}_total"] == sum(r[c] for r in mine) for c in PLAYER_COUNTS)
    kept = players.stored_player_season(tables.player_box, players.percentile_columns(players.PERCENTILE_SPECS))
    assert "opp_efg" not in kept.columns and kept.count() == len(got)
