"""Queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, mixing, periodic, personal, quality, recompress, rollups, secrets, simhash, suffixes, urls, warc
from .common import materialize, work_dir
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.hex("fp")  # of the little-endian bytes
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, reach=4)
    return found.select("doc_id", F.lower(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return secrets.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return recompress.cut_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load with estimates, its revision by real counts, the deletion of copies, and late repeats of all three."""
    docs = _table(spark, sf_dir, "documents")
    folder = work_dir(spark)
    estimate = rollups.count_by(docs, "estimate-1", F.ceil(F.col("n_chars") / 4))
    counted = materialize(rollups.count_tokens(docs, "byte-bpe-50k"))
    copies = materialize(rollups.copies(docs, counted))
    batches = {
        "0001-load": rollups.inserts(estimate),
        "0002-revise": rollups.revisions(estimate, counted),
        "0003-copies": rollups.deletes(copies),
    }
    for batch in [*batches, *batches]:
        rollups.commit(batches[batch], folder, batch)
    return rollups.totals(spark, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    counts = ("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum")
    return alignment.tokens(_table(spark, sf_dir, "documents")).select(*counts, groups)


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE_KINDS))
    return personal.scan(_table(spark, sf_dir, "documents")).select("doc_id", *map(count, personal.BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("best")
    return periodic.collapse(docs.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text")).alias("text"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_url_rules, op4_simhash, op5_decontamination, op6_quality_rules, op7_secrets, op8_recompression, op9_token_rollups, op10_warc, op11_alignment, op12_personal, op13_periodic_runs)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
