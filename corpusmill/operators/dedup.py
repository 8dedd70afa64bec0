"""Exact and near duplicates of documents by content hash, MinHash and banded buckets."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens, content_hash, for_tokens, ngrams, words

SLOTS, SHINGLE = 128, 5
BANDS = {"strict": (8, 16), "loose": (16, 8)}
LEVEL2, LEVEL3 = 0.88, 0.71
PRIME = (1 << 31) - 1
#: Signatures that a task gives back at once, and shingles that it takes at once.
BATCH, STEP = 1024, 256


def slope(i: int) -> int:
    return 1 + i * 2654435761 % (PRIME - 1)


def shift(i: int) -> int:
    return (i * 40503 * 65537 + 12345) % PRIME


def shingles(text: Column, n: int = SHINGLE) -> Column:
    return ngrams(all_tokens(text), n)


def signatures(docs: DataFrame, slots: int = SLOTS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, content_hash, sig): the least (a * base + b) mod p of each slot; sig is empty for texts without tokens."""
    rows = docs.select("doc_id", content_hash(F.col("text")).alias("content_hash"), for_tokens(F.col("text")).alias("text"))
    hashed, signed = _hashed(n), _signed(slots)
    return rows.mapInArrow(lambda batches: signed(hashed(batches)), "doc_id long, content_hash string, sig array<long>")


def bases(text: str, n: int) -> np.ndarray:
    """The first 28 bits of the MD5 of each of a text's ``shingles``, each once."""
    found = [w.encode() for w in words(text)]
    if not found:
        return np.empty(0, dtype=np.int64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    first, last = [0, *ends[: max(len(found) - n, 0)].tolist()], (ends[min(n, len(found)) - 1 :] - 1).tolist()
    digests = b"".join([md5(joined[i:j]).digest() for i, j in zip(first, last, strict=True)])
    return np.unique(np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) >> 4)


def _hashed(n: int):
    """A task's first step in ``signatures``: the hashes of shingles, of BATCH texts at once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                every = [bases(t, n) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("content_hash"), lists], names=["doc_id", "content_hash", "base"])

    return run


def _signed(slots: int):
    """A task's work in ``signatures``: from the hashes of shingles, one text at a time, BATCH of them given back at once."""
    a = np.array([slope(i) for i in range(slots)], dtype=np.int64)
    b = np.array([shift(i) for i in range(slots)], dtype=np.int64)

    def run(batches):
        held, over = (np.empty((STEP, slots), dtype=np.int64) for _ in range(2))

        def one(base: np.ndarray) -> np.ndarray:
            best = np.full(slots, PRIME, dtype=np.int64)
            for k in range(0, len(base), STEP):
                part = base[k : k + STEP, None]
                x, y = held[: len(part)], over[: len(part)]
                np.add(np.multiply(part, a, out=x), b, out=x)
                # modulo 2^31 - 1 the higher bits count once more; what is left is below twice the prime
                np.right_shift(x, 31, out=y)
                np.add(np.bitwise_and(x, PRIME, out=x), y, out=x)
                np.subtract(x, PRIME, out=y)
                low = x.view(np.uint64)
                np.minimum(low, y.view(np.uint64), out=low)  # a negative one is large there
                np.minimum(best, x.min(axis=0), out=best)
            return best

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = part.column("base")
                cuts, every = found.offsets.to_numpy(), found.values.to_numpy(zero_copy_only=False)
                sigs = [one(every[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
                ends = np.cumsum(np.r_[0, (np.diff(cuts) > 0) * slots]).astype(np.int32)
                flat = np.concatenate([np.empty(0, dtype=np.int64), *sigs])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("content_hash"), lists], names=["doc_id", "content_hash", "sig"])

    return run


def exact_groups(docs: DataFrame) -> DataFrame:
    """(content_hash, first_id, n) of contents that occur more than once."""
    hashed = docs.select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def exact_members(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, class_id) of every document: the least doc_id of its content."""
    hashed = docs.select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.join(hashed.groupBy("content_hash").agg(F.min("doc_id").alias("class_id")), "content_hash").select("doc_id", "content_hash", "class_id")


def classes(signed: DataFrame) -> DataFrame:
    """(class_id, sig, members): one row for each signature; equal signatures need no comparison."""
    return signed.where(F.size("sig") > 0).groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))


def members(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document: its class in ``reps``, null for texts without tokens."""
    return signed.select("doc_id", "sig").join(reps.select("sig", "class_id"), "sig", "left").select("doc_id", "class_id")


def buckets(signed: DataFrame, key: str) -> DataFrame:
    """(key, variant, band, bucket) of both banding schemes."""
    parts = [
        F.struct(F.lit(v).alias("variant"), F.lit(k).alias("band"), F.sha2(F.array_join(F.slice("sig", k * rows + 1, rows), ",").cast("binary"), 256).alias("bucket"))
        for v, (bands, rows) in BANDS.items()
        for k in range(bands)
    ]
    return signed.select(key, F.inline(F.array(*parts)))


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b, strict, loose): pairs of classes that share buckets, with the votes of each scheme."""
    keyed = buckets(reps, "class_id")
    left, right = keyed.withColumnRenamed("class_id", "a"), keyed.withColumnRenamed("class_id", "b")
    pairs = left.join(right, ["variant", "band", "bucket"]).where("a < b")
    votes = [F.count_if(F.col("variant") == v).alias(v) for v in BANDS]
    return pairs.groupBy("a", "b").agg(*votes)


def near_pairs(reps: DataFrame) -> DataFrame:
    """(a, b, jaccard, level) of classes: level 2 from 0.88, level 3 from 0.71 of equal slots."""
    sig = lambda n: reps.select(F.col("class_id").alias(n), F.col("sig").alias(f"sig_{n}"))
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    found = candidates(reps).join(sig("a"), "a").join(sig("b"), "b").select("a", "b", (equal / SLOTS).alias("jaccard"))
    return found.where(F.col("jaccard") >= LEVEL3).withColumn("level", F.when(F.col("jaccard") >= LEVEL2, 2).otherwise(3))


def flags(signed: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, has_duplicates): its class or content has other members, or the class has a near one."""
    near = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct().withColumn("near", F.lit(True))
    marked = reps.join(near, "class_id", "left").select("sig", ((F.col("members") > 1) | F.col("near").isNotNull()).alias("by_class"))
    content = signed.where(F.size("sig") > 0).groupBy("content_hash").agg((F.count("*") > 1).alias("by_content"))
    out = signed.join(marked, "sig", "left").join(content, "content_hash", "left")
    return out.select("doc_id", (F.coalesce("by_class", F.lit(False)) | F.coalesce("by_content", F.lit(False))).alias("has_duplicates"))
