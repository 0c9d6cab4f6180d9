"""What a table's making leaves on disk: shuffle files and steps go when the table is written."""

import os
import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hardwood import session
from hardwood.plans import players
from hardwood.schemas import PLAYER_BOX, PLAYER_COUNTS


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def player_rows(n=3000):
    """Games of one, two and three teams, missing keys and counts, players that change team, rows that come twice."""
    rnd = random.Random(11)
    pick = lambda v, share=0.03: None if rnd.random() < share else v
    rows = []
    for i in range(n):
        game = rnd.randrange(n // 12)
        team = (game + rnd.randrange(1 + game % 3)) % 9
        counts = {c: pick(float(rnd.randrange(9))) for c in PLAYER_COUNTS}
        rows.append((
            pick(2020 + game % 3), pick(f"g{game}"), pick(date(2020, 1, 1) + timedelta(days=game)), pick(str(team)), pick(str(rnd.randrange(90))),
            "somebody", pick(rnd.choice(["G", "F", "C", "G-F"])), pick(float(rnd.randrange(40))), rnd.random() < 0.4, pick(rnd.random() < 0.05), *counts.values(), i,
        ))
    return rows + [(*r[:-1], n + j) for j, r in enumerate(rows[:40])]


@pytest.fixture(scope="module")
def box(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "box")
    spark.createDataFrame(player_rows(), PLAYER_BOX + ", seq bigint").write.parquet(path)
    return spark.read.parquet(path)


def test_shuffle_files_of_a_stored_table_go_with_its_writing(spark):
    before = shuffle_files(spark)
    kept = session.materialize(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert kept.agg(F.count("k"), F.sum("s")).first()[:] == (97, 20_000 * 19_999 // 2)
    assert spark.conf.get(session._FREE_SHUFFLES) == "false"


def test_steps_keep_the_last_tables(spark):
    with session.steps():
        first = session.materialize(spark.range(10))
        with session.steps(keep=2):
            session.materialize(first)
            a, b = session.materialize(first.where("id > 3")), session.materialize(first.where("id > 5"))
        last = session.materialize(a.join(b, "id"))
    assert sorted(r.id for r in last.collect()) == [6, 7, 8, 9]
    assert all(not os.path.exists(f.inputFiles()[0].removeprefix("file://")) for f in (first, a, b))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables that the box and the schedule are made of."""
    path = tmp_path_factory.mktemp("tables")
    made = {
        "orders": spark.range(300).selectExpr(
            "id AS o_orderkey", "id * 7 % 60 AS o_custkey", "date_add(DATE'2020-01-01', cast(id * 5 % 900 AS int)) AS o_orderdate",
            "element_at(array('1-URGENT', '2-HIGH', '5-LOW'), cast(id % 3 + 1 AS int)) AS o_orderpriority", "if(id % 4 = 0, 'O', 'F') AS o_orderstatus"),
        "lineitem": spark.range(1500).selectExpr(
            "id % 300 AS l_orderkey", "id * 13 % 80 AS l_partkey", "id * 11 % 40 AS l_suppkey", "cast(id / 300 AS int) + 1 AS l_linenumber",
            "cast(id % 50 AS double) AS l_quantity", "if(id % 6 = 0, 'R', 'N') AS l_returnflag"),
        "part": spark.range(80).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size"),
        "supplier": spark.range(40).selectExpr("id AS s_suppkey", "id % 5 AS s_nationkey"),
        "nation": spark.range(5).selectExpr("id AS n_nationkey", "id % 2 AS n_regionkey"),
        "region": spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
    }
    for name, df in made.items():
        df.write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_player_season_query_joins_its_tables_once(spark, folder):
    from hardwood.catalog import query_table

    out = query_table()["player_season"](spark, folder)
    assert out.count() > 100
    # the answer is made of stored steps, so no exchange of the tables' own rows is held while it is written
    assert not [f for f in out.inputFiles() if any(t in f for t in ("lineitem.parquet", "orders.parquet", "part.parquet"))]


@pytest.mark.parametrize("name", ["weighted_percentile_pos", "pizza_long", "percentiles_in_conference"])
def test_percentile_queries_leave_no_box_and_one_season_table(spark, folder, name):
    from hardwood.catalog import query_table

    first = len(session._STORED)
    out = query_table()[name](spark, folder)
    kept = [spark.read.parquet(p).columns for p in session._STORED[first:]]
    assert out.count() > 100 and kept
    assert not [c for c in kept if "minutes" in c]
    assert sum("usage" in c for c in kept) == 1


def test_staged_season_has_the_same_rows(spark, box):
    names = [c for c in players.player_season(box).columns if c not in players.PER_GAME]  # a player without a known game has none
    rounded = lambda df: sorted(map(repr, df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*names).dtypes]).collect()))
    want = rounded(players.player_season(box))
    assert len(want) > 200
    assert rounded(players.staged_player_season(box)) == want
    few = ["season", "athlete_id", "usage"]
    kept = players.stored_player_season(box, few)
    assert sorted(map(repr, kept.select(*few).collect())) == sorted(map(repr, players.player_season(box).select(*few).collect()))


def test_percentile_rows_travel_as_numbers_in_lots_of_metrics(spark, monkeypatch):
    from hardwood.operators import percentiles as P

    rnd = random.Random(3)
    specs = {f"p{i}": (f"x{i}", f"w{i}") for i in range(9)}
    values = lambda: [v for _ in specs for v in (rnd.choice([None, 0.0, round(rnd.random(), 2)]), rnd.choice([None, 0.0, 1.0, 5.0]))]
    rows = [(2020 + i % 2, str(i) if i % 50 else None, rnd.choice(["G", "F", None]), *values(), i * 3) for i in range(600)]
    names = ", ".join(f"{x} double, {w} double" for x, w in specs.values())
    df = spark.createDataFrame(rows, f"season int, athlete_id string, position string, {names}, _row bigint")
    stored = []
    monkeypatch.setattr(P, "materialize", lambda d: stored.append(session.materialize(d)) or stored[-1])
    tie = [F.col("season"), F.col("athlete_id").cast("bigint"), F.col("position")]
    made = [
        {r["_row"]: [r[p] for p in specs] for r in P.weighted_percentiles(df, specs, ["position"], ["season", "athlete_id"], tie, row).collect()}
        for row in (None, "_row")
    ]
    assert made[1] == made[0] and len(made[1]) == 600
    assert all(v is None for r in rows if r[1] is None for v in made[1][r[-1]])
    assert any(v is not None for r in rows for v in made[1][r[-1]])
    # no stored table holds the rows of all metrics, nor what is only needed to sort them
    sizes = [s.select("metric").distinct().count() for s in stored[len(stored) // 2:]]
    assert sum(sizes) == len(specs) and max(sizes) < len(specs)
    assert all(not {"x", "season", "athlete_id"} & set(s.columns) for s in stored[len(stored) // 2:])
