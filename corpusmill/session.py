"""Session settings that the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "corpusmill", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; events carry microseconds without a zone and are read as UTC."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables up to so many rows are broadcast.
MOST_BROADCAST = 200_000


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks a table for broadcast if it has at most ``most`` rows; the count stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows that ``dealt`` gives a task, on average.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A table of so many rows dealt out by keys to as many tasks as it needs: a task's share stays the same as the table grows."""
    spark = df.sparkSession
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, -(-rows // DEALT_ROWS)), *keys)


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's executors, once; they need not find it on a path of their own."""
    context = spark.sparkContext
    if getattr(context, "_corpusmill", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / root.name
    context.addPyFile(shutil.make_archive(str(archive), "zip", root.parent, root.name))
    context._corpusmill = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir; where it is unset, a local folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/corpusmill-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
