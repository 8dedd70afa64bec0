"""Token counts kept as rollups of signed deltas.

A batch of inserts, deletes and revised counts is a table of signed rows; what it adds to the totals by source, language
and tokenizer version is written aside and then renamed to a folder of the batch's own id, so it is seen in whole or not at
all. An id that is there already, or that a compaction has taken up, is not written again: a repeated delivery changes
nothing and a lost driver only repeats the batch. Totals are sums over the batches; ``compact`` folds them into one and
keeps the list of their ids.

Null texts count 0 tokens; null sources and languages are groups of their own. A document that is revised is deleted with
its old count and inserted with its new one. Repeated rows count each. Groups without documents and tokens are left out, so
an empty table gives no rows. Further columns are ignored, so names may clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

KEYS = ("source", "lang", "version")
#: Public byte-level vocabulary as ranks, and the pattern that cuts texts before it applies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A larger vocabulary is refused, as it is broadcast.
MOST_RANKS = 300_000
_encoders: dict = {}


def _ranks(path: str) -> tuple[str, dict[bytes, int]]:
    """(digest of the vocabulary, its ranks)."""
    with open(path, "rb") as lines:
        raw = lines.read()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{path} has {len(ranks)} entries")
    return hashlib.sha1(raw).hexdigest(), ranks


def count_tokens(docs: DataFrame, version: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, lang, version, tokens): byte-pair tokens of each whole text."""
    digest, entries = _ranks(vocabulary)
    ranks = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches):
        import tiktoken

        key = digest, pattern
        if key not in _encoders:
            _encoders[key] = tiktoken.Encoding(digest, pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encode = _encoders[key].encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("source"), batch.column("lang"), pa.array([version] * len(n)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEYS, "tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


def count_by(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """As count_tokens, by an expression."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def inserts(ledger: DataFrame) -> DataFrame:
    return ledger.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(ledger: DataFrame) -> DataFrame:
    return ledger.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that replace the counts of ``before`` by those of ``after``; documents in both with equal counts cancel."""
    return deletes(before).unionByName(inserts(after))


def _summed(deltas: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum(docs).alias("docs"), F.sum(tokens).alias("tokens"))


def _files(spark: SparkSession, folder: str):
    """(file system of the folder, function from a name to its path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: path(root, name)


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders of all committed batches."""
    files, at = _files(spark, folder)
    found = files.listStatus(at("deltas")) if files.exists(at("deltas")) else []
    return sorted(f.getPath().getName() for f in found if f.getPath().getName().startswith("batch="))


def _taken_up(spark: SparkSession, folder: str) -> DataFrame:
    """(batch): folder names of the batches that a compaction has taken up."""
    files, at = _files(spark, folder)
    if not files.exists(at("applied")):
        return spark.createDataFrame([], "batch string")
    return spark.read.schema("batch string").parquet(f"{folder}/applied")


def commit(deltas: DataFrame, folder: str, batch: str) -> bool:
    """Adds a batch of (source, lang, version, sign, tokens) to the rollup in ``folder``; False if its id has been there before."""
    spark = deltas.sparkSession
    files, at = _files(spark, folder)
    name = f"batch={quote(batch, safe='')}"
    if files.exists(at(f"deltas/{name}")) or not _taken_up(spark, folder).where(F.col("batch") == name).isEmpty():
        return False
    aside = f"_aside-{uuid.uuid4().hex}"
    _summed(deltas, F.col("sign").cast("long"), F.col("sign") * F.col("tokens")).write.parquet(f"{folder}/{aside}")
    files.mkdirs(at("deltas"))
    if not files.rename(at(aside), at(f"deltas/{name}")):
        files.delete(at(aside), True)
        return False
    return True


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(source, lang, version, docs, tokens) over all committed batches."""
    schema = "source string, lang string, version string, docs long, tokens long"
    paths = [f"{folder}/deltas/{name}" for name in _batches(spark, folder)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return _summed(rows, F.col("docs"), F.col("tokens")).where("docs <> 0 OR tokens <> 0")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Writes the totals as the only batch of a new rollup, with the ids of all batches in them. The new folder appears in
    whole and then takes the place of the old one, which must get no batches meanwhile."""
    parent, _, last = target.rstrip("/").rpartition("/")
    files, at = _files(spark, parent)
    aside = f"_aside-{uuid.uuid4().hex}"
    ids = spark.createDataFrame([(name,) for name in _batches(spark, folder)], "batch string")
    _taken_up(spark, folder).unionByName(ids).distinct().write.parquet(f"{parent}/{aside}/applied")
    totals(spark, folder).write.parquet(f"{parent}/{aside}/deltas/batch=compacted-{uuid.uuid4().hex}")
    if not files.rename(at(aside), at(last)):
        raise FileExistsError(target)


def copies(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ``ledger`` whose document has the text of a document with a smaller id."""
    marked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("same"))
    first = marked.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = marked.join(materialize(first), "same").where("doc_id > first").select("doc_id").distinct()
    return ledger.join(materialize(again), "doc_id", "left_semi")
