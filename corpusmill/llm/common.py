"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (bytes.split() cuts at the same bytes).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate and str.translate: A to Z become a to z, all else stays.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, _UPPER, _LOWER)


def word_array(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share: spark.checkpoint.dir, or a local folder where it is unset in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no shared folder")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/corpusmill-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = folder or work_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, size: Column, target: int, least: int | None = None) -> tuple[int, int]:
    """(partitions, total) so that each partition holds about ``target`` of ``size``; one pass over the size column."""
    total = int(df.agg(F.sum(size)).first()[0] or 0)
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // target)), total


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """(row: all columns of ``docs``, own...): a table whose other names no table can clash with; ``select("row.*")`` gives it back."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *own)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores in front if a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: 64-bit words of a sieve: 2 MB of bits, whatever the number of ids.
SIEVE_WORDS = 1 << 18


def sieved(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, rows that have none): each row of ``docs`` with a key is in one of the two.

    A bit is set for each id and looked up for each row; a row without the bit has no id of them, so a join on the ids can leave it
    where it is. What is broadcast has SIEVE_WORDS rows at most. The more ids, the more rows the first part has besides those
    that it must have; with millions of ids and more it holds nearly all of them and the join moves what it would move without.
    """
    where = lambda c: F.xxhash64(F.col(c).cast("long"))
    word, bit = (lambda h: F.pmod(h, F.lit(SIEVE_WORDS))), (lambda h: F.shiftrightunsigned(h, 58).cast("int"))
    bits = ids.select(where(key).alias("h")).groupBy(word(F.col("h")).alias("_sieve_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("_sieve_bits"))
    rows = docs.where(F.col(key).isNotNull()).withColumn("_sieve_hash", where(key))
    rows = rows.join(F.broadcast(bits), word(F.col("_sieve_hash")) == F.col("_sieve_word"), "left")
    has = F.coalesce(F.call_function("shiftright", "_sieve_bits", bit(F.col("_sieve_hash"))).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.where(has).select(*docs.columns), rows.where(~has).select(*docs.columns)
