"""Catalogue work: composed filters, facets, sorting and paging, usage counts, reconciliation, trees."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import few, settled

#: Fixed value: nodes on the longest path that counts.
MOST_DEPTH = 32


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_locales(c: Column, codes: list[str], unknown: bool) -> Column | None:
    """Locale among codes, or unknown (null) if asked for; no condition without either."""
    known = c.isin(*codes) if codes else None
    if not unknown:
        return known
    return c.isNull() if known is None else known | c.isNull()


def any_tag(tags: list[Column], wanted: list[str]) -> Column:
    return any_of([F.coalesce(F.arrays_overlap(t, F.array(*map(F.lit, wanted))), F.lit(False)) for t in tags])


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page in order with the total of all rows; order must end with a unique key.

    The total is counted once beside the top rows instead of a window over everything, so no task sees all rows.
    """
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(size).withColumn("total", F.lit(total))


def after(df: DataFrame, key: str, cursor: int | None, size: int) -> DataFrame:
    """Keyset page: keys below the cursor, falling, with one row more than the page to tell whether another follows."""
    rows = df if cursor is None else df.where(F.col(key) < cursor)
    return rows.orderBy(F.col(key).desc()).limit(size + 1)


def facet(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def usage(names: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """How many active links each name has, 0 included; links has the same key."""
    counted = links.groupBy(key).agg(F.count("*").alias("n"))
    return names.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): what only one of two stores has."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def by_range(rows: DataFrame, value: str, rules: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Rows with each rule whose bounds hold the value; the rules are broadcast if they are few."""
    return rows.join(few(rules), F.col(value).between(F.col(low), F.col(high)))


def ancestry(edges: DataFrame, node: str = "node", parent: str = "parent", depth: int = MOST_DEPTH) -> DataFrame:
    """(node, root, depth, path) of each node, by walking down from nodes without a parent. A node whose path has more than
    ``depth`` nodes, leads to a parent that is not there, or runs in a circle has no root, no depth and an empty path."""
    level = settled(edges.where(F.col(parent).isNull()).select(F.col(node).alias("node"), F.col(node).alias("root"), F.lit(0).alias("depth"), F.array(node).alias("path")))
    down = edges.where(F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        if len(levels) == depth:
            break
        level = settled(
            down.join(level, F.col("_p") == F.col("node")).select(
                F.col("_n").alias("node"), "root", F.lit(len(levels)).alias("depth"), F.concat("path", F.array("_n")).alias("path")
            )
        )
    found = reduce(DataFrame.unionByName, levels or [level])
    rest = edges.select(F.col(node).alias("node")).join(found.select("node"), "node", "left_anti")
    kind = found.schema
    return found.unionByName(rest.select("node", *[F.lit(None).cast(kind[c].dataType).alias(c) for c in ("root", "depth")], F.array().cast(kind["path"].dataType).alias("path")))


#: Names on the right that one pass of ``best_match`` holds.
PASS_NAMES = 20_000


def best_match(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, likeness): for each distinct left name the most alike of all right names, the least name among equals, if the
    likeness reaches ``least``. The likeness is that of two lower-cased names' longest matching blocks.

    Right names are broadcast PASS_NAMES at a time. Lengths and letter counts bound the likeness, so few pairs are compared.
    """
    spark = left.sparkSession
    names = right.select(b).where(F.col(b).isNotNull()).distinct()
    passes = max(1, -(-names.count() // PASS_NAMES))
    asked = left.select(a).where(F.col(a).isNotNull()).distinct()
    found = []
    for k in range(passes):
        some = spark.sparkContext.broadcast([r[0] for r in names.where(F.pmod(F.xxhash64(b), F.lit(passes)) == k).toLocalIterator()])
        found.append(settled(asked.mapInPandas(_matcher(some, a, b, least), f"{a} string, {b} string, likeness double")))
        some.unpersist()
    best = F.min_by(b, F.struct((-F.col("likeness")).alias("l"), F.col(b).alias("b"))).alias(b)
    return reduce(DataFrame.unionByName, found).groupBy(a).agg(best, F.max("likeness").alias("likeness"))


def _matcher(some, a: str, b: str, least: float):
    def run(frames):
        known = sorted((name, name.lower(), Counter(name.lower())) for name in some.value)
        for frame in frames:
            rows = []
            for name in frame[a]:
                asked, letters = name.lower(), Counter(name.lower())
                matcher = SequenceMatcher(None, "", asked)
                best = (least, None)
                for other, low, has in known:
                    both = len(low) + len(asked)
                    bar = best[0] if best[1] is None else best[0] + 1e-9
                    if both and 2 * min(len(low), len(asked)) < bar * both or both and 2 * (letters & has).total() < bar * both:
                        continue
                    matcher.set_seq1(low)
                    ratio = matcher.ratio()
                    if ratio >= bar:
                        best = (ratio, other)
                if best[1] is not None:
                    rows.append((name, best[1], round(best[0], 6)))
            yield pd.DataFrame(rows, columns=[a, b, "likeness"])

    return run


def tag_union(rows: DataFrame, group: str, tag: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def conflicts(rows: DataFrame, alias: str, owner: str) -> DataFrame:
    """Aliases that several owners have."""
    return rows.groupBy(alias).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner")).where("owners > 1")
