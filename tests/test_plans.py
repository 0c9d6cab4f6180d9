import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.operators import events as E
from hardwood.plans import lineups as LU
from hardwood.plans import possessions as PO
from hardwood.plans import ratings as RT
from hardwood.plans import season as SE
from hardwood.plans import stints as ST
from hardwood.plans import winprob as WP
from hardwood.schemas import LEAGUE_RULES, LINEUP_PRESETS, LINEUP_WEIGHTS
from walkers import walk_possessions, walk_stints


def by_game(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["game_id"]].append(r.asDict())
    return out


def test_possessions_equal_a_row_walk(tables):
    events = by_game(PO.prepared_events(tables.pbp))
    got = by_game(PO.possession_state(PO.possession_rows(PO.prepared_events(tables.pbp))))
    for game, rows in events.items():
        rows.sort(key=lambda r: r["idx"])
        want, lost = walk_possessions(rows)
        name = {rows[0]["home_team_id"]: rows[0]["home_team_abbrev"], rows[0]["away_team_id"]: rows[0]["away_team_abbrev"]}
        a = [(i, p["period"], name[p["off"]], p["why"], p["end_why"], int(p["pts"]), p["context"], p["oreb"], p["start_idx"], p["end_idx"]) for i, p in enumerate(want, 1)]
        mine = sorted(got[game], key=lambda r: r["poss_id"])
        b = [(p["poss_id"], p["period"], p["off_team"], p["start_reason"], p["end_reason"], p["points"], p["context"], p["had_oreb"], p["start_idx"], p["end_idx"]) for p in mine]
        assert a == b
        assert sum(p["uncredited"] for p in mine) == lost


PBP = "period_number int, clock_display_value string, team_id string, type_text string, text string, scoring_play boolean, score_value double, athlete_id_1 string, athlete_id_2 string"


def hand_game(spark, rows):
    df = spark.createDataFrame(rows, PBP)
    return df.withColumn("_i", F.monotonically_increasing_id()).select(
        F.lit("wnba").alias("league"), F.lit("x").alias("game_id"), F.col("_i").cast("double").alias("sequence_number"), *df.columns,
        F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"), F.lit("H").alias("home_team_id"),
        F.lit("A").alias("away_team_id"), F.lit("HOM").alias("home_team_abbrev"), F.lit("AWY").alias("away_team_abbrev"),
        F.lit("2024-01-01").cast("date").alias("game_date"), F.lit(0.0).alias("coordinate_x"), F.lit(0.0).alias("coordinate_y"),
    )


def ev(period, clock, team, text, made=False, value=None, a=None, b=None, kind=""):
    return (period, clock, team, kind, text, made, value, a, b)


def test_and_one_made_and_missed(spark):
    made = hand_game(spark, [
        ev(1, "9:50", "H", "layup", True, 2.0), ev(1, "9:50", "A", "foul"), ev(1, "9:50", "H", "free throw 1 of 1", True, 1.0),
        ev(1, "9:30", "A", "misses jumper"), ev(1, "9:28", "H", "defensive rebound"),
    ])
    p = sorted(PO.possessions(made).collect(), key=lambda r: r.poss_id)
    assert [(r.off_team, r.points, r.end_reason) for r in p] == [("HOM", 3, "made_fg"), ("AWY", 0, "dreb"), ("HOM", 0, "period_end")]
    missed = hand_game(spark, [
        ev(1, "9:50", "H", "layup", True, 2.0), ev(1, "9:50", "H", "misses free throw 1 of 1"), ev(1, "9:49", "A", "defensive rebound"),
        ev(1, "9:30", "A", "jumper", True, 2.0),
    ])
    p = sorted(PO.possessions(missed).collect(), key=lambda r: r.poss_id)
    assert [(r.off_team, r.points) for r in p] == [("HOM", 2), ("AWY", 2), ("HOM", 0)]


def test_period_opening_and_trips(spark):
    g = hand_game(spark, [
        ev(1, "10:00", "H", "enters the game", kind="Substitution", a="h6", b="h1"), ev(1, "10:00", "A", "foul"),
        ev(1, "9:40", "A", "makes free throw", True, 1.0, a="a1"), ev(1, "9:40", "H", "subbing in for team", kind="Substitution", a="h7"),
        ev(1, "9:40", "A", "makes free throw", True, 1.0, a="a1"), ev(2, "10:00", "H", "bad pass turnover (steals)"), ev(2, "9:55", "A", "dunk", True, 2.0),
    ])
    p = sorted(PO.possessions(g).collect(), key=lambda r: r.poss_id)
    assert (p[0].off_team, p[0].start_reason, p[0].points, p[0].end_reason) == ("AWY", "period_start", 2, "made_ft")
    assert [r.context for r in p if r.off_team == "AWY" and r.start_reason == "steal"] == ["transition"]
    trips = E.free_throw_trips(PO.prepared_events(g)).collect()
    assert sorted((r.shot_num, r.trip_size) for r in trips) == [(1, 2), (2, 2)]


def test_stints_equal_a_row_walk(tables):
    events = by_game(
        E.substitution_groups(E.event_flags(E.order_events(tables.pbp)))
        .withColumn("scored_text", X.matches("text", "makes")).withColumn("inferred", X.inferred_points("text").cast("double"))
    )
    got, report = by_game(ST.lineup_stints(tables.pbp, tables.starters)), by_game(ST.stint_report(tables.pbp, tables.starters))
    first = defaultdict(lambda: defaultdict(set))
    for r in tables.starters.where("starter").collect():
        first[r.game_id][r.team_id].add(r.athlete_id)
    for game, rows in events.items():
        rows.sort(key=lambda r: r["idx"])
        rule = LEAGUE_RULES[rows[0]["league"]]
        want, bad, phantom = walk_stints(rows, first[game], lambda p: float(rule["period_seconds"] if p <= rule["reg_periods"] else rule["ot_seconds"]))
        q = report[game][0]
        assert (q["n_unresolved"], q["n_phantom"]) == (bad, phantom)
        if q["failed"]:
            assert not got[game]
            continue
        name = {rows[0]["home_team_id"]: rows[0]["home_team_abbrev"], rows[0]["away_team_id"]: rows[0]["away_team_abbrev"]}
        a = sorted((i, name[t], s["period"], int(s["pts"][t]), tuple((s["floor"][t] + [None] * 5)[:5]), len(s["floor"][t]) == 5) for i, s in enumerate(want, 1) for t in name)
        b = sorted((s["stint_id"], s["team"], s["period"], s["team_pts"], tuple(s[f"player_id_{i}"] for i in range(1, 6)), s["lineup_valid"]) for s in got[game])
        assert a == b


def test_periods_tile(spark):
    subs = [
        ev(1, "7:00", "H", "enters the game", a="h6", kind="Substitution"), ev(1, "7:00", "H", "enters the game for", a="h7", b="h2", kind="Substitution"),
        ev(1, "5:48", "A", "subbing out", a="a1", kind="Substitution"), ev(1, "5:48", "A", "subbing in", a="a6", kind="Substitution"),
        ev(1, "2:00", "H", "makes layup", True, 2.0), ev(2, "58.9", "A", "enters for", a="a7", b="a6", kind="Substitution"),
    ]
    starters = spark.createDataFrame([("x", t, f"{t.lower()}{i}", True) for t in "HA" for i in range(1, 6)], "game_id string, team_id string, athlete_id string, starter boolean")
    rows = ST.lineup_stints(hand_game(spark, subs), starters).where("team = 'HOM'").collect()
    total = defaultdict(float)
    for r in rows:
        total[r.period] += r.stint_seconds
    assert total == {1: 600.0, 2: 600.0}
    assert sum(r.team_pts for r in rows) == 2


def games_frame(spark, seed=3, seasons=2, teams=6, per=60):
    rnd = np.random.default_rng(seed)
    rows = []
    for s in range(seasons):
        for i in range(per):
            h, a = rnd.choice(teams, 2, replace=False)
            day = f"20{20 + s}-{1 + (i // 24):02d}-{1 + i % 24:02d}"
            rows.append((f"{s}-{i}", 2020 + s, day, 70.0 + float(i % 5), f"t{h}", f"t{a}", float(rnd.normal(5, 12)), bool(i % 7 == 0)))
    return spark.createDataFrame(rows, "game_id string, season int, d string, pace double, home string, away string, home_net double, neutral boolean").withColumn("date", F.to_date("d")).drop("d"), rows


def dense(rows, lam, decay):
    out, prior = {}, {}
    for season in sorted({r[1] for r in rows}):
        g = [r for r in rows if r[1] == season]
        teams = sorted({t for r in g for t in (r[4], r[5])})
        b0 = np.array([prior.get(t, 0.0) for t in teams] + [0.0, 0.0])
        last = None
        for d in sorted({r[2] for r in g}):
            before = [r for r in g if r[2] < d]
            x, y = np.zeros((len(before), len(teams) + 2)), np.array([r[6] for r in before])
            for k, r in enumerate(before):
                x[k, teams.index(r[4])], x[k, teams.index(r[5])], x[k, len(teams) + int(r[7])] = 1, -1, 1
            pen = np.diag([lam] * len(teams) + [1e-8, 1e-8])
            beta = np.linalg.solve(x.T @ x + pen, x.T @ y + pen @ b0)
            played = {t for r in before for t in (r[4], r[5])}
            last = {t: beta[i] for i, t in enumerate(teams) if t in played or b0[i] != 0}
            out |= {(season, d, t): v for t, v in last.items()}
        prior = {t: v * decay for t, v in last.items()} if decay > 0 else {}
    return out


def test_ridge_equals_dense_solve(spark):
    df, rows = games_frame(spark)
    got = RT.ridge_ratings(df, [(3.0, 0.9), (3.0, 0.0), (1.0, 0.9)]).collect()
    for lam, decay in ((3.0, 0.9), (3.0, 0.0), (1.0, 0.9)):
        mine = {(r.season, str(r.date), r.team): r.rating for r in got if r["lambda"] == lam and r.decay == decay}
        want = dense(rows, lam, decay)
        assert mine.keys() == want.keys()
        assert max(abs(mine[k] - want[k]) for k in want) < 1e-6


def test_ratings_use_only_earlier_games(spark):
    df, rows = games_frame(spark)
    cut = sorted({r[2] for r in rows if r[1] == 2021})[20]
    changed = df.withColumn("home_net", F.when(F.col("date") >= cut, 99.0).otherwise(F.col("home_net")))
    key = lambda x: {(r.team): round(r.rating, 9) for r in RT.margin_ratings(x).where(F.col("date") == cut).collect()}
    assert key(df) == key(changed)


def test_as_of_lookup_takes_one_table_date(spark):
    rated = [("a", "2024-01-01", 1.0), ("b", "2024-01-01", 3.0), ("c", "2024-01-01", 9.0), ("a", "2024-01-05", 2.0), ("b", "2024-01-05", 4.0)]
    r = spark.createDataFrame(rated, "team string, d string, rating double").select(
        "team", F.to_date("d").alias("date"), "rating", F.lit(3.0).alias("home_term"), F.lit(1.0).alias("neutral_term"), F.lit(1).alias("n_games"))
    q = spark.createDataFrame([("q1", "2024-01-04", "a", "b", False), ("q2", "2024-01-05", "a", "b", True), ("q3", "2023-01-01", "a", "b", False),
                               ("q4", "2024-01-09", "c", "a", False), ("q5", "2024-01-09", "a", "c", False)],
                              "request_id string, d string, home string, away string, neutral boolean").withColumn("date", F.to_date("d"))
    got = {x.request_id: (x.spread_home, x.reason) for x in RT.matchup_spreads(q, r, pace=100.0).collect()}
    assert got == {"q1": (1.0, None), "q2": (-2.0, None), "q3": (None, "no table yet"), "q4": (None, "home team not rated"), "q5": (None, "away team not rated")}
    paces = spark.createDataFrame([("a", 70.1), ("b", 66.0)], "team string, pace double")
    assert {x.request_id: x.pace for x in RT.matchup_spreads(q, r, paces).collect()} == {"q1": 68.0, "q2": 68.0, "q3": 68.0, "q4": 70.6, "q5": 70.6}


def test_lineups_equal_brute_force(spark):
    rnd = np.random.default_rng(9)
    pos = ["G", "F", "C", "G-F", "F-C"]
    rows = [(f"p{i:02d}", pos[i % 5], "Vet" if i % 3 else None, 30, float(rnd.uniform(.1, .3)), float(rnd.uniform(.4, .6)), float(rnd.uniform(.05, .2)), float(rnd.uniform(0, .15)), float(rnd.uniform(.1, .4))) for i in range(14)]
    df = spark.createDataFrame(rows, "player string, position string, contract_type string, games_played int, usage double, efg_pct double, tov_pct double, oreb_pct double, fta_rate double")
    w, bounds = LINEUP_WEIGHTS, LINEUP_PRESETS["balanced"]
    for core in (["p00", "p01"], ["p00", "p01", "p02"], ["p00", "p01", "p02", "p03"]):
        want = []
        for add in combinations([r for r in rows if r[0] not in core], 5 - len(core)):
            five = [r for r in rows if r[0] in core] + list(add)
            if any(not lo <= sum(p in r[1].split("-") for r in five) <= hi for p, (lo, hi) in bounds.items()):
                continue
            u = sum(r[4] for r in five)
            st = ((u * 100 if u < 2 else u) / 100) ** .25
            s = w["intercept"] + w["efg"] * sum(r[4] / u * r[5] / st for r in five) + w["tov"] * sum(r[4] / u * r[6] * st for r in five) + w["oreb"] * np.mean([r[7] for r in five]) + w["ftr"] * np.mean([r[8] for r in five])
            want.append((-round(s, 2), ", ".join(r[0] for r in add)))
        got = [(-r.projected_net, r.added_players) for r in LU.best_additions(df, core, "balanced", 5).collect()]
        assert got == sorted(want)[:5]
    kept = {r.player for r in LU.candidate_pool(df, ["p00"], 24, ["Vet"]).collect()}
    assert "p00" in kept and "p03" not in kept
    with pytest.raises(ValueError):
        LU.best_additions(df, ["p00", "nobody"])


SCHED = [("1", "2026-01-01", "AAA", "BBB", 70., 65., 4), ("2", "2026-01-03", "BBB", "CCC", 60., 58., 4), ("3", "2026-01-05", "CCC", "AAA", 55., 70., 4),
         ("4", "2026-01-07", "AAA", "CCC", 80., 70., 4), ("5", "2026-01-09", "BBB", "AAA", 75., 71., 5), ("6", "2026-01-11", "AAA", "BBB", 62., 68., 4)]


def test_season_summary(spark):
    s = spark.createDataFrame(SCHED, "game_id string, d string, home_abbreviation string, away_abbreviation string, home_score double, away_score double, status_period int").select(
        "*", F.to_date("d").alias("game_date"), F.lit(2026).alias("season"), F.lit(True).alias("status_type_completed"))
    prof = spark.createDataFrame([(t, "context", c, int(n * f)) for t, n in (("AAA", 300), ("BBB", 300), ("CCC", 200)) for c, f in (("transition", .2), ("second_chance", .1), ("halfcourt", .7))], "team string, dimension string, category string, off_n int")
    r = {x.team: x for x in SE.season_summary(s, "wnba", profile=prof, last_games=2).collect()}
    assert sum(x.games for x in r.values()) == 12 and sum(x.wins for x in r.values()) == 6 == sum(x.losses for x in r.values())
    assert r["AAA"].record == "3-2" and r["AAA"].minutes == 205 and r["AAA"].last_n_record == "0-2"
    assert r["AAA"].pace == pytest.approx(300 / 205 * 40)
    cut = {x.team: x for x in SE.season_summary(s, "wnba", profile=prof, as_of="2026-01-05").collect()}
    assert cut["AAA"].record == "2-0" and cut["AAA"].pace is None
    assert SE.season_summary(s, "wnba").first().pace is None


def test_season_pace_joins_on_every_key(spark):
    """Two seasons and two leagues with the same teams, about 70 possessions a game of 40 minutes."""
    games = [(lg, yr, f"{lg}{yr}{i}", "AAA", "BBB", 70.0 + i, 65.0, 4 if lg == "wnba" else 2) for lg in ("wnba", "mbb") for yr in (2025, 2026) for i in range(4)]
    s = spark.createDataFrame(games, "league string, season int, game_id string, home_abbreviation string, away_abbreviation string, home_score double, away_score double, status_period int").select(
        "*", F.to_date(F.lit("2026-01-01")).alias("game_date"), F.lit(True).alias("status_type_completed"))
    rows = [(lg, yr, t, "context", c, n) for lg, k in (("wnba", 280), ("mbb", 272)) for yr in (2025, 2026) for t in ("AAA", "BBB") for c, n in (("halfcourt", k - 40), ("transition", 40))]
    prof = spark.createDataFrame(rows, "league string, season int, team string, dimension string, category string, off_n int")
    got = SE.season_summary(s, None, profile=prof, by=["league", "season", "team"]).collect()
    assert len(got) == 8 and {(r.league, r.pace) for r in got} == {("wnba", 70.0), ("mbb", 68.0)}
    assert all(40 < r.pace < 110 and r.games == 4 for r in got)
    with pytest.raises(ValueError):
        SE.season_summary(s, None, profile=prof.drop("season"), by=["league", "season", "team"])


def test_local_fit_recovers_a_curve():
    rnd = np.random.default_rng(2)
    x = np.column_stack([rnd.uniform(0, 49, 4000), rnd.uniform(-40, 40, 4000), rnd.uniform(-30, 30, 4000)])
    p = 1 / (1 + np.exp(-(x[:, 1] * 0.12 + x[:, 2] * 0.05)))
    n = np.full(4000, 50.0)
    for at in ([10., 0., 0.], [20., 8., -9.], [30., -8., 9.]):
        true = 1 / (1 + np.exp(-(at[1] * 0.12 + at[2] * 0.05)))
        assert WP.local_logit(x, n, n * p, np.array(at), 0.1) == pytest.approx(true, abs=0.02)


def test_calculator_rules(spark):
    v = WP.vertex_table(spark).withColumn("p", 1 / (1 + F.exp(-(F.col("ball_margin") * 0.2 + 0.3))))
    s = spark.createDataFrame([("lead", 0, 3.0, 0.0, True, 0), ("behind", 0, -1.0, 0.0, True, 0), ("level", 0, 0.0, 0.0, True, 0), ("mine", 100, 0.0, 0.0, True, 0),
                               ("theirs", 100, 0.0, 0.0, False, 0), ("one", 100, 0.0, 0.0, True, 1), ("two", 100, 0.0, 0.0, True, 2)],
                              "situation_id string, secs int, ball_margin double, spread_ball double, has_ball boolean, ft_shots int")
    r = {x.situation_id: x.win_prob for x in WP.score_situations(s, v).collect()}
    assert (r["lead"], r["behind"]) == (1.0, 0.0) and r["level"] == pytest.approx(0.5)
    assert r["mine"] + r["theirs"] == pytest.approx(1 / (1 + np.exp(-.3)) + 1 - 1 / (1 + np.exp(-.3)))
    vert = {(x.i, x.j, x.k): x.p for x in v.collect()}
    line = lambda m: float(np.interp(m, WP.AXES["ball_margin"]["vertices"], [vert[(0, j, 0)] for j in range(len(WP.AXES["ball_margin"]["vertices"]))]))
    nb = lambda m: 1 - line(-m)
    f1 = lambda m: .71 * nb(m + 1) + .29 * (.2 * line(m) + .8 * nb(m))
    assert r["one"] == pytest.approx(f1(0)) and r["two"] == pytest.approx(.71 * f1(1) + .29 * f1(0))


def test_ties_and_one_point_leads_are_bins_of_their_own(spark):
    rows = spark.createDataFrame([(1.4, m, 0.4, m > 0) for m in (-60, -2, -1, 0, 0, 1, 2, 60)], "t double, ball_margin int, spread_ball double, ball_win boolean")
    got = {(r.t, r.ball_margin): (r.n, r.wins) for r in WP.binned(rows).collect()}
    assert got == {(1.0, float(m)): (2 if m == 0 else 1, int(m > 0)) for m in (-60, -2, -1, 0, 1, 2, 60)}


def test_prediction_beats_the_leader_rule_near_the_end(spark):
    """Where the truth is a steep logistic of the margin, the surface follows it, between vertices and beyond them too."""
    true = lambda m, t: 1 / (1 + math.exp(-3.0 * m / (1 + 0.1 * t)))
    v = WP.vertex_table(spark)
    v = v.withColumn("p", 1 / (1 + F.exp(-3.0 * F.col("ball_margin") / (1 + 0.1 * F.col("t")))))
    rows = spark.createDataFrame([(t, float(m), 0.0) for t in (0.0, 3.0) for m in (-50, -12, -1, 0, 1, 2, 5, 12, 50)], "t double, ball_margin double, spread_ball double")
    for r in WP.predict(rows, v).collect():
        assert r.p == pytest.approx(min(max(true(r.ball_margin, r.t), 1e-6), 1 - 1e-6), abs=2e-3)
    assert WP.predict(rows.where("ball_margin = 0"), v).agg(F.avg("p")).first()[0] == pytest.approx(0.5)
