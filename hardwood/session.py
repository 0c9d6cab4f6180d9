"""Session helpers: builder defaults and the reliable checkpoint folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "hardwood", **conf: str) -> SparkSession:
    """Session with the settings the plans assume: AQE, UTC, Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_STORED: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for stored tables: the one that spark.checkpoint.dir names, else one in the session's warehouse."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/hardwood-stage")
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name for files next to the stored tables; it goes with them."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


#: Spark's setting that deletes the shuffle files of an execution when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there.

    Cuts lineage, survives lost executors and lets later readers prune columns. One pass, unlike
    `checkpoint()`, which computes the last stage twice. The shuffle files behind the table go as soon as it is written, the
    tables when the driver's Python ends, by `release`, or as steps on the way to another one (`steps`).
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "hardwood")
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(keep: int = 1) -> Iterator[None]:
    """Of the tables stored inside only the last ones stay: those before them were steps on the way to them."""
    first = len(_STORED)
    yield
    done = _STORED[first:-keep]
    del _STORED[first:-keep]
    for path in done:
        _delete(path)


#: Rows of a task that sorts wide rows several times over, about.
TASK_ROWS = 40_000


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt by key into a stated number of parts, of about TASK_ROWS or fewer.

    Spark merges parts by their compressed bytes, so the rows of a task, and with them the memory of its sorts, would grow
    with the input; it leaves a stated number of parts as it is. The rows are counted first.
    """
    rows = df.count()
    wanted = max(-(-rows // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 2_000)))
    return df.repartition(max(1, wanted), *keys)


def _delete(path: str) -> None:
    jvm = SparkContext._gateway.jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


@atexit.register
def release() -> None:
    """Delete the tables that this driver stored; frames that read them can't be used afterwards."""
    while _STORED and SparkContext._gateway is not None:
        try:
            _delete(_STORED.pop())
        except (Py4JError, OSError):  # the JVM is gone; the folder's own retention clears up
            return
