"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("season",)) -> None:
    """Parquet by partition; a rerun replaces only the partitions it carries."""
    (
        df.repartition(*by, *[c for c in ("game_id",) if c in df.columns])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )


def write_split(good: DataFrame, bad: DataFrame, path: str, dead_letter: str) -> None:
    """Good rows to the table, failed ones with their reason next to it."""
    good.write.mode("overwrite").parquet(path)
    bad.write.mode("overwrite").parquet(dead_letter)


def write_version(good: DataFrame, rejected: DataFrame, folder: str) -> int:
    """Write a snapshot and its dead letters as the next version; returns its number.

    Rows go to folders of their own version first; the small `versions` table, written last, is what readers follow, so a write
    that is cut off changes nothing for them, and both parts appear at once. Versions stay until someone deletes them.
    """
    spark = good.sparkSession
    last = versions(spark, folder).agg(F.max("version").alias("v")).first().v or 0
    version = last + 1
    good.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")
    rejected.write.mode("overwrite").parquet(f"{folder}/rejected/version={version}")
    counts = [spark.read.parquet(f"{folder}/{part}/version={version}").count() for part in ("rows", "rejected")]
    spark.createDataFrame([tuple(counts)], "n_rows long, n_rejected long").write.mode("overwrite").parquet(f"{folder}/versions/version={version}")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """version, n_rows, n_rejected of the complete versions."""
    try:
        held = spark.read.parquet(f"{folder}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version int, n_rows long, n_rejected long")
    return held.select(F.col("version").cast("int").alias("version"), "n_rows", "n_rejected")


def read_version(spark: SparkSession, folder: str, rejected: bool = False, version: int | None = None) -> DataFrame:
    """Rows (or dead letters) of the latest complete version, or of a given one; one that isn't there is an error."""
    held = versions(spark, folder)
    if version is not None:
        held = held.where(F.col("version") == version)
    found = held.agg(F.max("version").alias("v")).first().v
    if found is None:
        raise LookupError(f"no complete version{'' if version is None else f' {version}'} in {folder}")
    return spark.read.parquet(f"{folder}/{'rejected' if rejected else 'rows'}/version={found}")
