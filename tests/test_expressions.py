import pytest
from pyspark.sql import functions as F

from hardwood.functions import clock as C
from hardwood.functions import geometry as G
from hardwood.functions import metrics as M
from hardwood.functions import text as X
from hardwood.functions.arrays import lineup_set, lineup_slots


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row.asDict()


def lits(*v):
    return [F.lit(x).cast("double") if x is None else F.lit(float(x)) for x in v]


def test_possessions_and_rates(spark):
    r = one(
        spark, simple=M.simple_possessions(*lits(85, 20, 14, 10)), other=M.simple_possessions(*lits(85, 20, 14, 10), ft_coef=0.475),
        efg=M.efg(*lits(40, 12, 88)), efg0=M.efg(*lits(0, 0, 0)), orb=M.rebound_share(*lits(10, 30)), orb0=M.rebound_share(*lits(0, 0)),
        ts=M.true_shooting(*lits(25, 20, 5)), pace=M.pace(*lits(100, 100, 48)), pace2=M.pace(*lits(105, 95, 48)),
    )
    assert r["simple"] == pytest.approx(97.8) and r["other"] == pytest.approx(98.5)
    assert r["efg"] == pytest.approx(46 / 88) and r["efg0"] is None
    assert r["orb"] == 0.25 and r["orb0"] is None
    assert r["ts"] == pytest.approx(25 / 44.4) and r["pace"] == 100 and r["pace2"] == 100


@pytest.mark.parametrize("p,minutes", [(4, 48.0), (5, 53.0), (6, 58.0), (None, None), (0, None)])
def test_game_minutes(spark, p, minutes):
    assert one(spark, m=M.pro_game_minutes(F.lit(p).cast("int")))["m"] == minutes


@pytest.mark.parametrize("league,period,secs", [("wnba", 1, 600), ("mbb", 1, 1200), ("mbb", 3, 300), ("nba", 3, 720), ("nba", 5, 300)])
def test_period_seconds(spark, league, period, secs):
    assert one(spark, s=C.period_seconds(F.lit(league), F.lit(period)))["s"] == secs


@pytest.mark.parametrize("text,secs", [("10:00", 600), ("5:37", 337), ("0:00", 0), ("58.9", 58.9), ("END", None), ("", None), (None, None)])
def test_clock(spark, text, secs):
    r = one(spark, s=C.clock_to_seconds(F.lit(text).cast("string")), back=C.seconds_to_clock(C.clock_to_seconds(F.lit(text).cast("string"))))
    assert r["s"] == secs
    if text and ":" in text:
        assert r["back"] == text
    if text == "58.9":
        assert r["back"] == "0:59"


@pytest.mark.parametrize("x,y,three,zone", [
    (39.75, 0, False, "at_rim"), (31.75, 2, False, "paint"), (30, 15, False, "mid_range"), (41.75, 22, True, "corner_3"),
    (34, 21, True, "corner_3"), (25, 22, True, "above_break_3"), (41.75, 20, True, "above_break_3"), (20, 0, True, "above_break_3"),
    (None, 3, True, None), (-39.75, 0, None, "at_rim"), (-34, -21, True, "corner_3"),
])
def test_zone(spark, x, y, three, zone):
    xs, ys = lits(x, y)
    assert one(spark, z=G.shot_zone(xs, ys, F.lit(three).cast("boolean")))["z"] == zone


@pytest.mark.parametrize("x,d", [(41.75, 0), (-41.75, 0), (31.75, 10), (-31.75, 10), (0, 41.75), (None, None)])
def test_distance(spark, x, d):
    xs, ys = lits(x, 0)
    assert one(spark, d=G.shot_distance(xs, ys))["d"] == d


@pytest.mark.parametrize("x,y,inside", [(38, 0, True), (28, 6, True), (38, 7, False), (27, 0, False), (0, 0, False)])
def test_paint(spark, x, y, inside):
    assert one(spark, p=G.in_paint(*lits(x, y)))["p"] is inside


def test_ordinals(spark):
    want = {1: "1st", 2: "2nd", 3: "3rd", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 73: "73rd", 111: "111th", 0: "0th"}
    df = spark.createDataFrame([(k,) for k in want], "n int").select("n", X.ordinal("n").alias("o"))
    assert {r.n: r.o for r in df.collect()} == want


def test_ranks_and_flip(spark):
    r = one(
        spark, top=X.rank_from_percentile(F.lit(100.0), F.lit(12)), low=X.rank_from_percentile(F.lit(0.0), F.lit(12)),
        flip=X.flip_percentile(F.lit(30.0)), none=X.flip_percentile(F.lit(None).cast("double")),
        fewest=X.inverted_standing(F.lit(100.0), F.lit(18), F.lit("league")), most=X.inverted_standing(F.lit(0.0), F.lit(18), F.lit("league"), True),
        pct=X.standing(F.lit(73.0), F.lit(363), F.lit("nation")), rk=X.standing(F.lit(100.0), F.lit(12), F.lit("league"), defense=True),
    )
    assert (r["top"], r["low"], r["flip"], r["none"]) == (1, 12, 70, None)
    assert r["fewest"] == "lowest of the league" and r["most"] == "highest"
    assert r["pct"] == "73rd percentile offensively" and r["rk"] == "1st of 12 defensively in the league"


def test_text_cleaning(spark):
    s = lambda v: F.lit(v).cast("string")
    r = one(
        spark, m=X.parse_minutes(s("32:30")), m2=X.parse_minutes(s("17")), m3=X.parse_minutes(s("")), n=X.clean_number(s("12*")),
        n0=X.clean_number(s("")), nn=X.clean_number(s(None)), short=X.short_name(s(" Ann  Lee Smith ")), solo=X.short_name(s("Cher")),
        pos=X.expand_position(s("G/F")), odd=X.expand_position(s("Wing")), empty=X.expand_position(s("")), slug=X.slug(s("Big Ten (W)")),
        ftk=X.free_throw_count(s("Made Free Throw 2 of 3"))[0], ftn=X.free_throw_count(s("free throw made"))[1],
        action=X.split_at_dash(s("Rim, 20% — crash the glass."))[0], evidence=X.split_at_dash(s("no dash here."))[1],
    )
    assert (r["m"], r["m2"], r["m3"]) == (32.5, 17.0, None) and (r["n"], r["n0"], r["nn"]) == (12.0, 0.0, None)
    assert (r["short"], r["solo"]) == ("A. Lee Smith", "Cher") and (r["pos"], r["odd"], r["empty"]) == ("Guard/Forward", "Wing", None)
    assert r["slug"] == "big_ten_w" and r["ftk"] == 2 and r["ftn"] is None
    assert r["action"] == "Crash the glass" and r["evidence"] == ""


def test_lineup_slots(spark):
    df = spark.createDataFrame([(["b", "a", None, "b"],)], "p array<string>").withColumn("five", lineup_set("p"))
    r = df.select(F.size("five").alias("n"), *lineup_slots("five")).first()
    assert (r.n, r.player_id_1, r.player_id_2, r.player_id_3) == (2, "a", "b", None)
