"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its source's size. Copies add up
along the source, one random offset is added, and a document is emitted once for each whole number that the sum crosses.
Documents are lined up by size, and every other stretch of that line is turned round, so that neighbours stand for each
other and the words taken come close to the target. Documents that hold over a fiftieth of their source are drawn first;
the others' expected copies then make up for what those took too much or too little.

The order needs every document's place within its source: documents are range-partitioned by source and size, numbered
inside each partition, and partition counts give the offsets, so no source meets in one task.

Null texts and empty ones have size 0: they are taken like others and add no words. Repeated rows are sampled each for
itself. A source of size 0 has target 0. Sources stand in the order of their code points, null last. An empty table gives
an empty result; further columns are ignored, so names may clash. The table of sources, one short row each, is ranked in
one task: a million sources are about 60 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
#: Percent of all words that the sources share, and the most copies of a document.
SHARE, MOST_COPIES = 150, 2
SEED = 17
#: Rows (without texts) that one task numbers, about.
PART_ROWS = 4_000_000
#: A document with more than its source's size over this is drawn first; a source has fewer than so many of them.
LARGE = 50


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source.

    Sources that reach their cap leave the rest to the others. In the order of cap over weight the capped sources come
    first: at each, the level is what earlier caps leave over the weights that are left. It rises while caps lie below it
    and falls behind them, so its greatest value is the one that all sources share.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    cap = (most * F.col("source_size")).cast("double")
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", cap).withColumn("place", place)
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) * (share / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.max("level").over(everything)
    out = out.withColumn("level", left / F.sum("weight").over(after)).withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
    return out.select("source", "source_size", "target")


def _offset(source: Column, seed: int) -> Column:
    """A random number in [0, 1) for each source, the same in every run."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``place``: 0, 1, 2... within each source by falling size, then doc_id, then the text's hash."""
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("same").asc_nulls_last()]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    rows = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", F.shiftright("at", 33)))
    first = rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = first.select(F.col("source").alias("_s"), F.col("part").alias("_p"), (ahead - F.col("first")).alias("shift"))
    joined = rows.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    return joined.withColumn("place", F.col("at") + F.col("shift")).drop("_s", "_p", "shift", "at", "part")


def _turned(place: Column, rate: Column) -> Column:
    """The place after every other stretch of the line is turned round; a stretch is taken (or left out) once, about."""
    part = rate - F.floor(rate)
    rarer = F.least(part, 1 - part)
    stretch = F.when(rarer > 1e-9, F.greatest(F.lit(1), F.round(1 / rarer))).otherwise(1).cast("long")
    block, within = F.floor(place / stretch), place % stretch
    return F.when(block % 2 == 1, block * stretch + stretch - 1 - within).otherwise(place)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, same, source, size, source_size, target, copies) for each document of (doc_id, text, source); same: a hash of the text."""
    sized = materialize(with_sizes(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("same"))).drop("text"))
    rows = numbered(sized)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = sources.withColumnRenamed("source", "_s")
    out = rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    out = out.withColumn("u", _offset(F.col("source"), seed)).withColumn("large", F.col("size") * LARGE > F.col("source_size"))

    def copies(at: Column, rate: Column) -> Column:
        edge = lambda k: F.floor((at + k) * rate + F.col("u"))
        return F.least(F.lit(most), edge(1) - edge(0)).cast("long")

    drawn = F.when(F.col("large"), copies(F.col("place"), F.col("rate")))
    first = out.where("large").groupBy(F.col("source").alias("_s")).agg(
        F.count("*").alias("n_large"), F.sum("size").alias("large_size"), F.sum(drawn * F.col("size")).alias("large_taken")
    )
    out = out.join(first, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    n_large, large_size, large_taken = (F.coalesce(c, F.lit(0)) for c in ("n_large", "large_size", "large_taken"))
    rest = F.col("source_size") - large_size
    other = F.when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - large_taken) / rest))).otherwise(F.col("rate"))
    out = out.withColumn("rate", F.when(F.col("large"), F.col("rate")).otherwise(other)).withColumn("place", F.col("place") - F.when(F.col("large"), 0).otherwise(n_large))
    at = F.when(F.col("large"), F.col("place")).otherwise(_turned(F.col("place"), F.col("rate")))
    return out.withColumn("copies", copies(at, F.col("rate"))).select("doc_id", "same", "source", "size", "source_size", "target", "copies")
