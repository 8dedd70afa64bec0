"""The corpus pipeline: five stages over ``documents``, each written to the shared folder before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, mixing, quality, secrets, similar
from corpusmill.llm.common import free_name, materialize, packed, sieved

#: Near duplicates: sets of five-word shingles with a Jaccard similarity of LEAST (over, under) or more.
SHINGLE, LEAST = 5, (4, 5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail go; failing lines of the others go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group stays; rows that are equal in id and text are one row of it, those without an id all
    stay. Null and empty texts are one group, long ones are compared whole, an empty table stays empty; columns may have any names."""
    found = similar.near_duplicates(docs, shingle=SHINGLE, least=LEAST).where("doc_id IS NOT NULL")
    marks = found.groupBy("doc_id", "same").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    marks = materialize(marks.select("doc_id", "same", "kept"))
    held = packed(docs, F.col("doc_id").alias("doc_id"), similar.same().alias("same"))
    rest, clear = sieved(held, marks, "doc_id")
    out = rest.join(marks.hint("merge"), ["doc_id", "same"], "left_anti")
    repeated = marks.where("kept")
    if not repeated.isEmpty():
        once = rest.join(repeated.hint("merge"), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"])
        out = out.unionByName(once)
    return out.unionByName(clear).unionByName(held.where("doc_id IS NULL")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows go together, other columns stay as they are."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; null texts stay null, all rows and other columns stay as they are."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, numbered from 1. Rows that are equal in id, text and source share what they
    are taken together, in equal parts. Null texts and sources count as mixing.mix says, an empty table stays empty; a table's own column
    "copy" stays and the number is then called "_copy"."""
    keys = {
        "id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull(), "same": F.xxhash64("text"),
        "src": F.coalesce("source", F.lit("")), "no_src": F.col("source").isNull(),
    }
    drawn = mixing.mix(docs).select(*[(F.col("same") if k == "same" else c).alias(k) for k, c in keys.items()], "copies")
    drawn = drawn.groupBy(*keys).agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 0")
    # plain keys, so that the window below finds its rows together as the join left them
    out = packed(docs, *[c.alias(k) for k, c in keys.items()]).join(drawn.hint("merge"), list(keys))
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    upto = lambda k: F.floor(F.col("n") * k / F.col("rows"))
    times = (upto(F.col("at")) - upto(F.col("at") - 1)).cast("int")
    out = out.withColumn("at", F.when(F.col("rows") > 1, at).otherwise(1)).withColumn("times", times).where("times > 0")
    return out.select("row.*", F.explode(F.sequence(F.lit(1), "times")).alias(free_name("copy", docs.columns)))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]

#: Fingerprints and token bounds are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
