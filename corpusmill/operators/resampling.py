"""Bootstrap intervals: every row carries its own seeded weights, one pass sums all replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1) probabilities up to 0, 1, ... events: a uniform number above so many of them is that many draws of a row.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020)
#: Hexadecimal digits of a uniform number; an MD5 holds four.
DIGITS = 8


def weights(row: Column, replicate: Column, seed: int) -> Column:
    """How often each of four replicates (4 * replicate to 4 * replicate + 3) draws a row: Poisson(1) by the hash of its id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), replicate.cast("string")).cast("binary"))
    uniform = lambda k: F.conv(F.substring(digest, k * DIGITS + 1, DIGITS), 16, 10).cast("double") / float(1 << 4 * DIGITS)
    draws = lambda u: sum([(u >= p).cast("int") for p in POISSON[1:]], (u >= POISSON[0]).cast("int"))
    return F.array(*[draws(uniform(k)) for k in range(4)])


def bootstrap_mean(rows: DataFrame, keys: list[str], row: str, value: str, *, replicates: int = 100, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(keys, mean, low, high): the mean of a value and the interval that holds ``level`` of its replicates' means, ends by nearest rank.

    A row's weights depend on its id and the seed alone, so any partitioning and any retry gives the same interval. Tasks sum
    their rows for each replicate before anything moves: keys times replicates rows from each. Null values count nowhere.
    """
    known = rows.where(F.col(value).isNotNull())
    quads = -(-replicates // 4)
    drawn = known.select(*keys, F.col(value).cast("double").alias("_x"), F.col(row).alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(quads - 1))).alias("_q"))
    drawn = drawn.select(*keys, "_x", "_q", weights(F.col("_row"), F.col("_q"), seed).alias("_w"))
    sums = [F.sum(F.col("_w")[k]).alias(f"n{k}") for k in range(4)] + [F.sum(F.col("_w")[k] * F.col("_x")).alias(f"s{k}") for k in range(4)]
    each = drawn.groupBy(*keys, "_q").agg(*sums).select(*keys, "_q", F.posexplode(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("s")) for k in range(4)])).alias("_k", "_s"))
    means = each.where((F.col("_q") * 4 + F.col("_k") < replicates) & (F.col("_s.n") > 0)).select(*keys, (F.col("_s.s") / F.col("_s.n")).alias("_m"))
    sides = means.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_m"))  # ``replicates`` at most
    at = lambda share: F.get(F.col("_m"), F.greatest(F.lit(0), F.ceil(F.lit(share) * F.size("_m")).cast("int") - 1))
    ends = sides.select(*keys, at(round((1 - level) / 2, 12)).alias("low"), at(round((1 + level) / 2, 12)).alias("high"))
    return known.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)
