"""The top-up takes every newer row of the feed, whatever its date."""

from pyspark.sql import functions as F

from hardwood.catalog import ingest


def test_incremental_topup_reaches_the_last_date(tables):
    box = tables.team_box
    newer = box.where(F.col("game_date") > ingest.CUT).select("game_id", "team_id", "pts", "game_date").distinct()
    got = ingest.incremental_topup(tables).where(F.col("game_date") > ingest.CUT).select("game_id", "team_id", "pts", "game_date")
    assert newer.where("game_date > '2001-05-31'").count() > 0
    assert got.count() == newer.count() and newer.exceptAll(got).count() == 0
