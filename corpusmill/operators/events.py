"""Event work: histograms, islands, intervals, limits, windows, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import admitted  # noqa: F401

#: Upper bounds of histogram cells, themselves included; what lies above has a cell of its own.
EDGES = (10_000, 50_000, 250_000, 1_000_000, 5_000_000, 30_000_000)


def histogram(rows: DataFrame, keys: list[str], value: Column, edges: tuple[float, ...] = EDGES) -> DataFrame:
    low = [None, *edges]
    cells = [
        F.count_if(((value > a) if a is not None else F.lit(True)) & ((value <= b) if b is not None else F.lit(True))).alias(f"le_{k}")
        for k, (a, b) in enumerate(zip(low, [*edges, None], strict=True))
    ]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("most"), *cells)


def islands(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``island``: counts the changes of ``value`` along the order."""
    w = W.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merged_spans(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end): overlapping or touching spans become one."""
    w = W.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(w))
    return marked.groupBy(group, "_k").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_k")


def trailing(rows: DataFrame, keys: list[str], seconds: Column, window: int, cost: Column) -> DataFrame:
    """Adds ``used``: the cost of all events of the key in the half-open window that ends here."""
    w = W.partitionBy(*keys).orderBy(seconds).rangeBetween(-window + 1, 0)
    return rows.withColumn("used", F.sum(cost).over(w))


def latest(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """The last row of each key, as a maximum of structs: partial aggregates, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def next_boundary(rows: DataFrame, group: str, order: str, is_start: Column) -> DataFrame:
    """Starts with ``next_start``, the order key of the group's next start (null for the last)."""
    return rows.where(is_start).withColumn("next_start", F.lead(order).over(W.partitionBy(group).orderBy(order)))


def guarded(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, n, ok): a batch in which a key repeats is refused as a whole."""
    return rows.groupBy(batch).agg(F.count("*").alias("n"), (F.count_distinct(key) == F.count("*")).alias("ok"))


def sessions(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Left rows with the last right value of the key at or before them: one sort of the union, no range join."""
    a = left.withColumns({"_ts": F.col(left_ts), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = W.partitionBy(key).orderBy("_ts", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_ts", "_side", "_v")


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of spans of a key that overlap, joined by the cells of ``width`` that they touch."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    a = left.select(key, F.col("id").alias("a"), F.col(start).alias("as_"), F.col(end).alias("ae"), cells.alias("_c"))
    b = right.select(key, F.col("id").alias("b"), F.col(start).alias("bs"), F.col(end).alias("be"), cells.alias("_c"))
    met = a.join(b, [key, "_c"]).where("as_ <= be AND bs <= ae")
    # each pair once: in the first cell that both touch
    return met.where(F.col("_c") == F.floor(F.greatest("as_", "bs") / width)).select(key, "a", "b")
