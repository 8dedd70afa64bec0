"""Writers: upserts, replacement by partition, publication, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import with_parts  # noqa: F401


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows with keys of their own."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that differ from the old row of their key in some column, nulls being equal."""
    was = old.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(was, key).where(~same).drop(*[f"_{c}" for c in columns])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df has rows for and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish(pointers: DataFrame, doc_id: int, generation: str, base: str | None) -> DataFrame:
    """Pointer rows (doc_id, generation, status) after ``generation`` went live; nothing changes if ``base`` is not the active one."""
    active = pointers.where((F.col("doc_id") == doc_id) & (F.col("status") == "active")).select("generation").first()
    ready = pointers.where((F.col("doc_id") == doc_id) & (F.col("generation") == generation) & (F.col("status") == "ready")).first()
    if ready is None or (active[0] if active else None) != base:
        raise ValueError("the base generation changed or the new one is not ready")
    own = F.col("doc_id") == doc_id
    status = F.when(own & (F.col("generation") == generation), "active").when(own & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return pointers.withColumn("status", status)


def digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(n, digest) of a table, whatever its order or partitions: the sum of row hashes."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, value).cast("decimal(38,0)")).alias("digest"))


def append_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def latest_of(spark: SparkSession, path: str, by: str = "version") -> DataFrame:
    """The rows of a partitioned table's greatest version."""
    table = spark.read.parquet(path)
    return table.where(F.col(by) == table.agg(F.max(by)).first()[0])


def purged(rows: DataFrame, doomed: DataFrame, key: str, deleted: str) -> DataFrame:
    """Rows without those of the doomed keys that are still deleted now: what was restored since the list was made stays, and so does
    what isn't there. A null key dooms nothing."""
    gone = doomed.select(F.col(key).alias("_doomed")).where("_doomed IS NOT NULL").distinct()
    return rows.join(gone, (F.col(key) == F.col("_doomed")) & F.col(deleted).isNotNull(), "left_anti")


def cloned(rows: DataFrame, base: str, generation: str, source: str, sources: DataFrame) -> DataFrame:
    """All rows, and those of the base generation whose source is selected once more under the new generation; a generation that has rows
    already gets none."""
    chosen = sources.select(F.col(source).alias("_s")).distinct()
    fresh = rows.where(F.col("generation") == base).join(chosen, F.col(source).eqNullSafe(F.col("_s")), "left_semi").withColumn("generation", F.lit(generation))
    there = rows.where(F.col("generation") == generation).select("generation").limit(1)
    return rows.unionByName(fresh.join(there, "generation", "left_anti"))
