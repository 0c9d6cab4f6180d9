import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators import percentiles as P
from hardwood.operators.aggregates import aggregate_games, calibration_table, leave_one_out_mean
from hardwood.operators.filters import find_team, population_games, quarantine, resolve_one_team, suggest_names
from hardwood.operators.pairing import malformed_games, pair_opponents, pair_two_sided
from hardwood.operators.reshape import keep_first
from hardwood.plans.profile import profile_from_categories
from hardwood.sources.contract import ids_as_text, standardize, top_up

BOX = "game_id string, team_id string, pts double, fga double, fgm double, fg3m double, fta double, oreb double, dreb double, tov double"
G1 = [("g1", "1", 110., 88., 42., 14., 20., 10., 35., 13.), ("g1", "2", 100., 85., 38., 10., 24., 12., 33., 15.)]


@pytest.mark.parametrize("pair", [pair_opponents, pair_two_sided])
def test_pairing(spark, pair):
    df = spark.createDataFrame(G1 + [("lone", "1", *G1[0][2:])], BOX)
    got = {r.team_id: (r.opp_pts, r.opp_oreb) for r in pair(df).collect()}
    assert got == {"1": (100.0, 12.0), "2": (110.0, 10.0)}
    assert [r.game_id for r in malformed_games(df).collect()] == ["lone"]


def test_three_rows_give_every_pair(spark):
    df = spark.createDataFrame(G1 + [("g1", "3", *G1[0][2:])], BOX)
    assert pair_opponents(df).count() == 6
    assert pair_two_sided(df).count() == 0


def test_sum_then_ratio(spark):
    mine = [(120., 90., 45., 15., 20., 10., 35., 12.), (80., 60., 30., 5., 10., 5., 30., 18.)]
    opp = [(110., 88., 42., 12., 18., 9., 33., 14.), (90., 62., 34., 8., 22., 11., 31., 13.)]
    names = ["pts", "fga", "fgm", "fg3m", "fta", "oreb", "dreb", "tov"]
    df = spark.createDataFrame([a + b for a, b in zip(mine, opp)], ", ".join(f"{n} double" for n in names + [f"opp_{n}" for n in names]))
    r = aggregate_games(df).first()
    assert r.games == 2 and r.pts == 200 and r.efg == pytest.approx((75 + 0.5 * 20) / 150)


def test_symmetry(tables):
    r = pair_two_sided(tables.team_box)
    a = aggregate_games(r).first()
    assert a.ortg == pytest.approx(a.drtg)


def brute_percentile(rows):
    live = sorted([(x, s, i, w or 0.0) for s, i, x, w in rows if x is not None])
    total = sum(w for *_, w in live)
    out, run = {}, 0.0
    for x, s, i, w in live:
        run += w
        out[(s, i)] = run / total if total > 0 else None
    return out


def test_weighted_percentile_matches_definition(spark):
    rnd = random.Random(5)
    # one group holds most rows and a third of the values are tied
    rows = [(2020 + i % 2, str(i), "G" if i % 10 else rnd.choice(["F", None]), None if i % 17 == 0 else (0.0 if i % 3 == 0 else round(rnd.random(), 2)),
             None if i % 13 == 0 else float(rnd.randint(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "season int, athlete_id string, position string, x double, w double")
    out = P.weighted_percentiles(df, {"p": ("x", "w")}, ["position"], ["season", "athlete_id"], [F.col("season"), F.col("athlete_id").cast("bigint")])
    got = {(r.season, int(r.athlete_id)): r.p for r in out.collect()}
    for g in ("G", "F", None):
        want = brute_percentile([(s, int(i), x, w) for s, i, p, x, w in rows if p == g])
        for k, v in want.items():
            assert got[k] == pytest.approx(v)
    assert all(got[(s, int(i))] is None for s, i, _, x, _ in rows if x is None)


def test_percentile_degenerate_groups(spark):
    df = spark.createDataFrame([(1, "1", "A", 1.0, 0.0), (1, "2", "A", 2.0, 0.0), (1, "3", "B", None, 3.0)], "season int, athlete_id string, position string, x double, w double")
    out = P.weighted_percentiles(df, {"p": ("x", "w")}, ["position"], ["season", "athlete_id"], [F.col("athlete_id").cast("bigint")])
    assert [r.p for r in out.collect()] == [None, None, None]


def test_group_average_equals_appending(spark):
    rnd = np.random.default_rng(1)
    x, w = rnd.integers(0, 20, 200) / 10, rnd.integers(0, 6, 200).astype(float)
    df = spark.createDataFrame([(1, str(i), "G", float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))], "season int, athlete_id string, position string, x double, w double")
    r = P.group_averages(df, {"m": ("x", "w")}, ["position"], ["season", "athlete_id"]).first()
    ok = w > 0
    avg = (x[ok] * w[ok]).sum() / w[ok].sum()
    xs, ws = np.append(x, avg), np.append(w, w.mean())
    order = np.argsort(xs, kind="stable")
    share = np.cumsum(ws[order]) / ws.sum()
    assert r.avg == pytest.approx(avg) and r.avg_percentile == pytest.approx(share[list(order).index(200)])


def test_percent_rank_and_bands(spark):
    vals = [3.0, 1.0, 1.0, None, 2.0]
    df = spark.createDataFrame([(i, "G", v) for i, v in enumerate(vals)] + [(9, "C", 7.0)], "id int, position string, v double")
    out = P.percent_ranks(df, ["v"], ["position"], ["id"], lone=0.5).withColumn("band", P.tercile_band("pct"))
    got = {r.id: (r.pct, r.band) for r in out.collect()}
    assert got[0] == (1.0, 3) and got[1] == (0.0, 1) and got[2] == (0.0, 1) and got[3] == (None, None)
    assert got[4][0] == pytest.approx(2 / 3) and got[9] == (0.5, 2)


def test_profile_percentile_floor(spark):
    rows = [("A", "Z", 100, 120), ("B", "Z", 100, 100), ("C", "Z", 100, 80), ("D", "Z", 5, 10)]
    df = spark.createDataFrame([(o, d, "context", "transition", "possession", n, p) for o, d, n, p in rows],
                               "off_team string, def_team string, dimension string, category string, unit string, n bigint, points bigint")
    got = {r.team: r.off_ppp_pctl for r in profile_from_categories(df).collect() if r.off_n}
    assert got == {"A": 100.0, "B": 50.0, "C": 0.0, "D": None}


def test_turnover_direction(spark):
    rows = [(t, "Z", "ball_security", cat, "possession", n, 0) for t, a, b in (("A", 60, 140), ("B", 100, 100)) for cat, n in (("live_ball_to", a), ("no_turnover", b))]
    df = spark.createDataFrame(rows, "off_team string, def_team string, dimension string, category string, unit string, n bigint, points bigint")
    got = {(r.team, r.category): r.off_ppp_pctl for r in profile_from_categories(df).collect() if r.off_n}
    assert got[("A", "live_ball_to")] == 100.0 and got[("B", "live_ball_to")] == 0.0
    assert got[("A", "no_turnover")] == 100.0


def test_leave_one_out(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 6.0), ("d", 4.0)], "g string, v double")
    got = {(r.g, r.v): r.o for r in leave_one_out_mean(df, ["g"], "v", "o").collect()}
    assert got == {("c", 1.0): 4.0, ("c", 2.0): 3.5, ("c", 6.0): 1.5, ("d", 4.0): None}


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, True), (0.1, False), (0.1000001, True), (1.0, True)], "p double, y boolean")
    assert {r.bin: r.n for r in calibration_table(df, "y", "p").collect()} == {1: 2, 2: 1, 10: 1}


def test_contract(spark):
    df = spark.createDataFrame([("g", 7.0, 1.0)], "GAME_ID string, TEAM_ID double, Points double")
    out = ids_as_text(standardize(df, {"points": "pts", "absent": "fga"}, required=["pts"]))
    assert out.first().asDict() == {"game_id": "g", "team_id": "7", "pts": 1.0}
    with pytest.raises(ValueError, match="tov"):
        standardize(df, {"points": "pts"}, required=["pts", "tov"])


def test_top_up(spark):
    base = spark.createDataFrame([("a", "2024-01-01", 1.0)], "game_id string, game_date string, pts double")
    extra = spark.createDataFrame([("a", "2024-01-01", "5", 1), ("b", "2024-01-02", "x", 1), ("b", "2024-01-02", "x", 2)], "game_id string, game_date string, pts string, junk int")
    got = sorted((r.game_id, r.pts) for r in top_up(base, extra, ["game_id"]).collect())
    assert got == [("a", 1.0), ("b", None)]


def test_lookup_and_quarantine(spark):
    n = spark.createDataFrame([("Ohio",), ("Ohio State",), ("Iowa",)], "team_name string")
    assert [r[0] for r in find_team(n, "ohio").collect()] == ["Ohio"]
    assert resolve_one_team(n, "iow") == "Iowa"
    with pytest.raises(ValueError):
        resolve_one_team(n.where("team_name <> 'Ohio'").unionByName(spark.createDataFrame([("Ohio U",)], "team_name string")), "ohio")
    assert suggest_names(n, "Iowq", "team_name").first().team_name == "Iowa"
    good, bad = quarantine(spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int"), {"no a": F.col("a").isNotNull(), "no b": F.col("b").isNotNull()})
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["no a", "no b"]


def test_population_games_keeps_either_side(spark):
    ev = spark.createDataFrame([("A", "B", 1), ("C", "A", 2), ("C", "D", 3)], "home_team_abbrev string, away_team_abbrev string, k int")
    pop = spark.createDataFrame([("A",)], "team string")
    assert sorted(r.k for r in population_games(ev, pop).collect()) == [1, 2]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in keep_first(df, ["k"], ["o"]).collect()) == [("a", "y"), ("b", "z")]
