"""Scans of landed snapshots and cache-or-compute tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood import schemas


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. A declared schema avoids the extra inference pass over the data."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_stints(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STINTS)


def read_possessions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.POSSESSIONS)


def read_feed(spark: SparkSession, root: str, table: str, league: str | None = None, seasons: Sequence[int] | None = None) -> DataFrame:
    """Landed feed snapshots stored as root/table/league=../season=..; partitions are pruned."""
    df = spark.read.parquet(f"{root}/{table}")
    if league is not None:
        df = df.where(F.col("league") == league)
    if seasons is not None:
        df = df.where(F.col("season").isin(list(seasons)))
    return df


def load_training_set(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, pure_only: bool = True) -> DataFrame:
    """Season files by partition pruning, pure rows by the pushed scan filter."""
    df = spark.read.parquet(path)
    if seasons is not None:
        df = df.where(F.col("season").isin(list(seasons)))
    return df.where(F.col("is_pure")) if pure_only else df


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Stored table if there is one, else the computed table stored first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, "_SUCCESS")
    if refresh or not fs.exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_conferences(spark: SparkSession, path: str) -> DataFrame:
    """Saved conference documents (JSON) flattened to conf_id, name, short_name and team_id rows."""
    shape = "struct<conferences:array<struct<groupId:string,name:string,shortName:string,teams:array<struct<id:string>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    conf = raw.select(F.inline("d.conferences"))
    return conf.select(
        F.col("groupId").alias("conf_id"), "name", F.col("shortName").alias("short_name"), F.explode("teams").alias("t")
    ).select("conf_id", "name", "short_name", F.col("t.id").alias("team_id"))
