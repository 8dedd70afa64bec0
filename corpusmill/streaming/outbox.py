"""An outbox as a stream: due rows are written once, others are held, unreadable ones are set aside; work by chunks resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder) if _there(spark, folder) else spark.createDataFrame([], schema)


def dispatch(folder: str, key: str, due: Callable[[], Column], valid: Column) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. Each batch takes its rows and those that the batch before it held: what is not ``valid`` goes to
    ``dead``, what is ``due`` now to ``sent``, the rest to ``held``, each to a folder of the batch's number.

    A batch that is lost at any point is run again under its number and with the same rows: it replaces what it wrote and takes no row that
    another batch sent, so nothing is lost and nothing is sent twice. A repeated id is sent once. Null ids are dead.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        rows = batch.unionByName(_read(spark, f"{folder}/held/batch={number - 1}", schema))
        fine = F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()
        sent = spark.read.parquet(f"{folder}/sent").where(F.col("batch") != number).select(key) if _there(spark, f"{folder}/sent") else None
        open_ = rows.where(fine).dropDuplicates([key])
        open_ = (open_.join(sent, key, "left_anti") if sent is not None else open_).withColumn("_due", F.coalesce(due(), F.lit(False))).select(*schema.names, "_due").persist()
        rows.where(~fine).write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        open_.where("_due").drop("_due").write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")
        open_.where("NOT _due").drop("_due").write.mode("overwrite").parquet(f"{folder}/held/batch={number}")
        open_.unpersist()

    return run


def resumed(rows: DataFrame, folder: str, key: str, chunk: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``work`` on all rows, chunk by chunk: a chunk whose results are in the folder is read, not worked again.

    All chunks that are open are worked together and written by one commit, a folder for each, so a run that stops leaves whole chunks or none.
    ``work`` keeps the columns ``key`` and ``chunk``; a chunk without results is worked again each time.
    """
    spark = rows.sparkSession
    done = spark.read.parquet(folder).select(chunk).distinct() if _there(spark, folder) else None
    left = rows.join(done.withColumn(chunk, F.col(chunk).cast(rows.schema[chunk].dataType)), chunk, "left_anti") if done is not None else rows
    out = work(left)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)
