"""The training set's walkers keep to parts of a stated number of rows, whatever the input."""

from pyspark.sql import functions as F


def test_training_set_has_bounded_parts_and_the_same_rows_for_any_number_of_parts(spark, monkeypatch, tmp_path):
    from hardwood import session
    from hardwood.plans import winprob as WP
    from hardwood.sources.adapters import load_view

    spark.range(2000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 700) AS ts", "id % 40 AS user_id",
        "element_at(array('purchase', 'view', 'click', 'error', 'signup'), cast(id * 7 % 5 + 1 AS int)) AS event_type", "id % 11 / 2e0 AS value",
    ).write.parquet(str(tmp_path / "events.parquet"))

    def made(task_rows):
        # code without the setting is to fail by the sizes of its parts
        monkeypatch.setattr(session, "TASK_ROWS", task_rows, raising=False)
        good, bad = WP.training_set(load_view(spark, str(tmp_path), "pbp"))
        sizes = [r["count"] for r in good.groupBy(F.spark_partition_id()).count().collect()]
        return sizes, sorted(map(repr, good.collect())), sorted(map(repr, bad.collect()))

    sizes, good, bad = made(100)
    assert len(good) > 500
    # 20 parts are asked for; the hash of 40 games leaves some of them empty
    assert len(sizes) >= 10 and max(sizes) < len(good) / 4
    few, same_good, same_bad = made(1_000_000)
    assert len(few) < len(sizes)
    assert (same_good, same_bad) == (good, bad)
