"""Filling stored tables for a list of games: stints and possessions, a ledger of every game and table, resumable.

A run reads the events of the games that the ledger doesn't settle yet, writes both tables under the run's own partition and the
ledger last. Readers follow the ledger, so a run that is cut off leaves nothing that counts, and a game is stored when the
ledger says so for each of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.plans.possessions import possessions
from hardwood.plans.stints import lineup_stints, stint_report
from hardwood.session import materialize

LEDGER_DDL = "game_id string, table_name string, ok boolean, reason string, n_rows long, run int"
NO_EVENTS, UNRESOLVED, NO_ROWS = "no events", "unresolved substitutions", "no rows"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """game_id, table_name, ok, reason, n_rows, run of all runs so far."""
    held = _read(spark, f"{folder}/ledger")
    return spark.createDataFrame([], LEDGER_DDL) if held is None else held.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in LEDGER_DDL.split(", ")])


def unsettled(wanted: DataFrame, book: DataFrame, retry: bool = False) -> DataFrame:
    """Wanted games that the ledger doesn't have; with `retry` also those with a table that failed."""
    done = book.groupBy("game_id").agg(F.bool_and("ok").alias("all_ok"))
    return wanted.select("game_id").distinct().join(done.where("all_ok") if retry else done, "game_id", "left_anti")


def fill(events: DataFrame, starters: DataFrame, wanted: DataFrame, folder: str, retry: bool = False) -> DataFrame:
    """Fill both tables for the unsettled games of `wanted`; returns the ledger rows of this run (none if nothing was to do).

    A game without events, one whose substitutions can't be resolved and one that gives no rows are listed with the reason;
    they don't stop the others. Games that failed aren't tried again unless `retry`.
    """
    spark = events.sparkSession
    book = ledger(spark, folder)
    games = materialize(unsettled(wanted, book, retry))
    last = book.agg(F.coalesce(F.max("run"), F.lit(0)).alias("run")).first().run
    if games.isEmpty():
        return spark.createDataFrame([], LEDGER_DDL)
    run = last + 1
    feed = materialize(events.join(games, "game_id", "left_semi"))
    floor = starters.join(games, "game_id", "left_semi")
    seen = feed.select("game_id").distinct().withColumn("_seen", F.lit(True))
    failed = stint_report(feed, floor).where("failed").select("game_id", F.lit(True).alias("_failed"))
    build: dict[str, Callable[[], DataFrame]] = {"stints": lambda: lineup_stints(feed, floor), "possessions": lambda: possessions(feed)}
    rows = None
    for name, make in build.items():
        path = f"{folder}/{name}/run={run}"
        make().write.mode("overwrite").parquet(path)
        counts = spark.read.parquet(path).groupBy("game_id").agg(F.count(F.lit(1)).alias("n_rows"))
        part = games.join(seen, "game_id", "left").join(failed, "game_id", "left").join(counts, "game_id", "left").withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    stored = F.col("n_rows") > 0
    reason = (
        F.when(F.col("_seen").isNull(), NO_EVENTS).when(F.col("_failed").isNotNull() & (F.col("table_name") == "stints"), UNRESOLVED)
        .when(~F.coalesce(stored, F.lit(False)), NO_ROWS)
    )
    out = rows.select("game_id", "table_name", reason.isNull().alias("ok"), reason.alias("reason"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    out.write.mode("overwrite").parquet(f"{folder}/ledger/run={run}")
    return ledger(spark, folder).where(F.col("run") == run)


def stored_rows(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Rows of a table that the ledger vouches for: of a game filled twice those of its last good run."""
    good = ledger(spark, folder).where("ok").where(F.col("table_name") == table)
    latest = good.groupBy("game_id").agg(F.max("run").cast("int").alias("run"))
    rows = spark.read.parquet(f"{folder}/{table}").withColumn("run", F.col("run").cast("int"))
    return rows.join(latest, ["game_id", "run"], "left_semi").drop("run")


def fill_report(book: DataFrame, wanted: DataFrame) -> DataFrame:
    """table_name, requested, stored, failed, missing and n_rows over the wanted games, from the ledger."""
    asked = wanted.select("game_id").distinct()
    last = book.groupBy("table_name", "game_id").agg(F.max_by(F.struct("ok", "n_rows"), "run").alias("l"))
    n = asked.agg(F.count(F.lit(1)).alias("requested"))
    done = last.join(asked, "game_id", "left_semi").groupBy("table_name").agg(
        F.count(F.when(F.col("l.ok"), 1)).alias("stored"), F.count(F.when(~F.col("l.ok"), 1)).alias("failed"), F.sum("l.n_rows").alias("n_rows")
    )
    return done.join(F.broadcast(n)).select("table_name", "requested", "stored", "failed", (F.col("requested") - F.col("stored") - F.col("failed")).alias("missing"), "n_rows")
