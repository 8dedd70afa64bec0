"""Signatures that are worked out once for each text: a table of them grows by what it lacks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..session import settled
from .dedup import SHINGLE, SLOTS, signatures

_KNOWN = "content_hash string, sig array<long>"


def parameters(slots: int, shingle: int) -> str:
    """The name of a set of parameters: signatures of others are never mixed with these."""
    return hashlib.sha256(f"minhash:{slots}:{shingle}".encode()).hexdigest()[:16]


def known(spark: SparkSession, folder: str, slots: int = SLOTS, shingle: int = SHINGLE) -> DataFrame:
    """(content_hash, sig) of what a folder holds for these parameters; nothing where none was written yet."""
    path = f"{folder}/{parameters(slots, shingle)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(_KNOWN).parquet(path) if there else spark.createDataFrame([], _KNOWN)


def grown(docs: DataFrame, folder: str, slots: int = SLOTS, shingle: int = SHINGLE) -> tuple[DataFrame, int]:
    """((doc_id, content_hash, sig) of all documents, number of texts that were new): only texts whose normalised content the folder lacks
    are signed, one of each, and added to it. A run that is lost before its files are committed adds nothing; two runs at once may add a
    text twice, with equal signatures, of which one is read."""
    hashed = docs.select("doc_id", "text", content_hash(F.col("text")).alias("content_hash"))
    held = known(docs.sparkSession, folder, slots, shingle)
    lacking = hashed.join(held.select("content_hash"), "content_hash", "left_anti")
    fresh = lacking.groupBy("content_hash").agg(F.min_by("text", "doc_id").alias("text"))
    signed = settled(signatures(fresh.select(F.lit(0).cast("long").alias("doc_id"), "text"), slots, shingle).select("content_hash", "sig"))
    signed.write.mode("append").parquet(f"{folder}/{parameters(slots, shingle)}")
    every = held.unionByName(signed).groupBy("content_hash").agg(F.first("sig").alias("sig"))
    return hashed.select("doc_id", "content_hash").join(every, "content_hash").select("doc_id", "content_hash", "sig"), signed.count()


def mail_identity(sender: Column, recipients: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """A mail's fingerprint: recipients in their order, white space of texts collapsed, attachment hashes as a sorted multiset."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    parts = F.struct(flat(sender).alias("from"), F.transform(some(recipients), flat).alias("to"), flat(subject).alias("subject"), flat(body).alias("body"), F.sort_array(some(attachments)).alias("attachments"))
    return F.sha2(F.to_json(parts).cast("binary"), 256)
