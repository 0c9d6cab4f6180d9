import pytest
from pyspark.sql import functions as F

from hardwood.plans import possessions as PO
from hardwood.plans.teams import team_efficiency
from hardwood.operators.pairing import pair_two_sided
from hardwood.sources import links, readers, resolve, sinks


def test_possessions_round_trip(spark, tables, tmp_path):
    p = PO.possessions(tables.pbp)
    sinks.write_csv(p, str(tmp_path / "p"))
    back = readers.read_possessions(spark, str(tmp_path / "p"))
    assert dict(back.dtypes)["poss_id"] == "int" and back.count() == p.count()


def test_csv_gives_equal_ratings(spark, tables, tmp_path):
    sinks.write_csv(tables.team_box, str(tmp_path / "b"))
    back = readers.read_csv(spark, str(tmp_path / "b")).withColumn("team_id", F.col("team_id").cast("string"))
    key = lambda df: {r.team_id: r.net_rtg for r in team_efficiency(pair_two_sided(df), "team_id").collect()}
    assert key(tables.team_box) == pytest.approx(key(back))


def test_partition_overwrite_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 2023, True), ("b", 2024, True), ("c", 2024, False)], "game_id string, season int, is_pure boolean")
    sinks.write_partitioned(df, path)
    sinks.write_partitioned(df.where("game_id = 'c'"), path)
    assert sorted(r.game_id for r in spark.read.parquet(path).collect()) == ["a", "c"]
    pure = readers.load_training_set(spark, path, [2023])
    plan = pure._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "IsNotNull(is_pure)" in plan
    assert [r.game_id for r in pure.collect()] == ["a"]


def test_cached_computes_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "c")
    assert readers.cached(spark, path, make).count() == 3 and readers.cached(spark, path, make).count() == 3
    assert len(calls) == 1
    readers.cached(spark, path, make, refresh=True)
    assert len(calls) == 2


def test_links_and_profiles(spark):
    pages = spark.createDataFrame([(1, "<a href='/contests/77/box'> <a href='/contests/77/x'> <a href='/teams/12'>")], "page_id int, html string")
    assert [r.link_id for r in links.link_ids(pages, links.GAME_LINK).collect()] == ["77"]
    assert [r.link_id for r in links.link_ids(pages, links.TEAM_LINK).collect()] == ["12"]
    prof = spark.createDataFrame([("wbb", "A", 2024, "t"), ("wbb", "A", 2024, "u"), ("nba", "B", 2025, "v")], "league string, population string, season int, team string")
    assert resolve.stored_profiles(prof, "wbb").count() == 1
    assert resolve.read_profile(prof, "nba", 2025, "B").count() == 1
    with pytest.raises(LookupError):
        resolve.read_profile(prof, "nba", 2020, "B")


def test_conference_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"conferences":[{"groupId":"7","name":"Big One","shortName":"B1","teams":[{"id":"3"},{"id":"4"}]}]}')
    got = readers.read_conferences(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r.conf_id, r.short_name, r.team_id) for r in got) == [("7", "B1", "3"), ("7", "B1", "4")]
