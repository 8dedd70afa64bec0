"""Knowledge rows: trees and scopes, concepts, evidence, lifecycle, queues."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TEXTS, Numbers, all_tokens, bound, for_tokens, words
from ..session import dealt
from .catalogue import MOST_DEPTH, ancestry
from .folds import folded

TRASH_DAYS, CHAT_DAYS = 14, 90
# Endings that the stem of a Russian word loses, the longest that fits, and the least that stays.
ENDINGS = (
    "ого", "его", "ыми", "ими", "ами", "ями", "иях", "ых", "их", "ах", "ях",
    "ой", "ей", "ов", "ев", "ий", "ый", "ая", "яя", "ое", "ее", "ые", "ие",
    "ом", "ем", "ым", "им", "ую", "юю", "ья", "ье", "ью", "ть", "ся", "сь",
    "а", "я", "о", "е", "и", "ы", "у", "ю", "ь",
)
LEAST_STEM = 5


def stem(word: Column) -> Column:
    """The word without the longest ending that leaves five letters; words of other letters stay."""
    return F.regexp_replace(word, rf"^([а-яё]{{{LEAST_STEM},}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def mentions(text: Column, words: Column) -> Column:
    """The words that the text holds, themselves or by their stem."""
    held = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(words, lambda w: F.contains(held, w) | F.contains(held, stem(w)))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5, in a namespace given as a UUID."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(raw, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128)))), 1, 2)
    part = lambda a, n: F.substring(raw, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def citations(text: Column) -> Column:
    """``block with ID N`` and its likes as ``[N]``; neighbouring repeats become one."""
    plain = F.regexp_replace(text, r"(?i)\b(?:block|source)s?\s+(?:with\s+)?(?:id\s+)?\[?([0-9]+)\]?", "[$1]")
    return F.regexp_replace(plain, r"(\[[0-9]+\])(?:\s*\1)+", "$1")


def set_entry(m: Column, key: str, value: Column) -> Column:
    """The map with one entry put or replaced."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def unique_slugs(rows: DataFrame, group: str, slug: str, order: str) -> DataFrame:
    """In the order of a group, a slug that is taken gets the first free of ``-1``, ``-2``... behind it. Null slugs stay null.

    A repeat's place among its equals is that number unless the name it makes is another row's. Such names differ in numbers at their
    end alone, so only families of slugs that are equal without those, and where that happens, are gone through in order. The state is
    the next number of each slug of a family.
    """
    out = rows.columns
    family = F.struct(F.col(group).alias("g"), F.regexp_replace(slug, "(-[0-9]+)+$", "").alias("f"))
    n = F.row_number().over(W.partitionBy(group, slug).orderBy(order)) - 1
    made = F.when((n > 0) & F.col(slug).isNotNull(), F.concat_ws("-", F.col(slug), n.cast("string"))).otherwise(F.col(slug))
    numbered = rows.withColumns({"_family": family, "_made": made})
    clash = numbered.groupBy("_family").agg((F.count_distinct("_made") < F.count("_made")).alias("_clash")).where("_clash").select("_family")

    def step(following: dict[str, int], base: str) -> list[tuple]:
        before, _, number = base.rpartition("-")
        taken = base in following or number.isdecimal() and number[0] != "0" and int(number) < following.get(before, 0)
        k = following.setdefault(base, 1)
        if not taken:
            return [(base,)]
        while f"{base}-{k}" in following:
            k += 1
        following[base] = k + 1
        return [(f"{base}-{k}",)]

    easy = numbered.join(clash, "_family", "left_anti").withColumn(slug, F.col("_made")).select(*out)
    hard = folded(rows.withColumn("_family", family).join(clash, "_family", "left_semi"), "_family", [order, slug], [slug], [("_made", "string", pa.string())], dict, step)
    return easy.unionByName(hard.withColumn(slug, F.col("_made")).select(*out))


def tree_faults(edges: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(group, nodes, repeated, roots, strays): strays have a parent that is not there; rows without a group have none. Each name of a group meets
    its nodes and its children in one row, then the names of a group are added up."""
    names = edges.select(group, F.explode(F.array(F.struct(F.col(node).alias("name"), F.lit(1).alias("own")), F.struct(F.col(parent).alias("name"), F.lit(0).alias("own")))).alias("x"))
    n = edges.count()
    met = dealt(names.select(group, "x.*"), 2 * n, group, "name").groupBy(group, "name").agg(F.sum("own").alias("own"), F.count_if(F.col("own") == 0).alias("children"))
    named, there = F.col("name").isNotNull(), (F.col("own") > 0) & F.col(group).isNotNull()
    one = met.select(
        group, "own", F.when(named & (F.col("own") > 0), 1).otherwise(0).alias("first"), F.when(named, 0).otherwise(F.col("children")).alias("roots"),
        F.when(named & ~there, F.col("children")).otherwise(0).alias("strays"),
    )
    total = lambda c: F.sum(c).cast("long")
    return dealt(one, 2 * n, group).groupBy(group).agg(
        total("own").alias("nodes"), (total("own") - total("first")).alias("repeated"), total("roots").alias("roots"), total("strays").alias("strays"),
    )


def inherited(edges: DataFrame, node: str, parent: str, flag: str, depth: int = MOST_DEPTH) -> DataFrame:
    """(node, depth, inherited): whether a node or any ancestor carries the flag; nodes without a whole path are left out."""
    paths = ancestry(edges.select(node, parent), node, parent, depth).where("root IS NOT NULL").select("node", "depth", F.explode("path").alias("up"))
    marked = edges.select(F.col(node).alias("up"), F.coalesce(F.col(flag), F.lit(False)).alias("_f"))
    return paths.join(marked, "up").groupBy("node", "depth").agg(F.bool_or("_f").alias("inherited"))


def evidence(facts: DataFrame, sources: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """Facts with ``proven``: whether the quote, white space collapsed, stands in its source."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    joined = facts.join(sources.select(key, flat(F.col(text)).alias("_t")), key, "left")
    said = flat(F.col(quote))
    return joined.withColumn("proven", (said != "") & F.coalesce(F.contains("_t", said), F.lit(False))).drop("_t")


def longest_run(a: Column, b: Column, least: int = 8) -> Column:
    """Whether some run of ``least`` tokens of one text stands in the other."""
    grams = lambda c: bound(all_tokens(c), lambda w: F.when(F.size(w) >= least, F.transform(F.sequence(F.lit(1), F.size(w) - least + 1), lambda i: F.array_join(F.slice(w, i, least), " "))))
    return F.coalesce(F.arrays_overlap(grams(a), grams(b)), F.lit(False))


def retention(rows: DataFrame, deleted: str, now: Column, days: int = TRASH_DAYS) -> DataFrame:
    """Adds ``days_left`` (null if not deleted) and ``expired``."""
    left = F.lit(days) - F.datediff(now, F.col(deleted))
    return rows.withColumn("days_left", F.when(left.isNotNull(), F.greatest(left, F.lit(0)))).withColumn("expired", F.coalesce(left <= 0, F.lit(False)))


def receipts(batches: DataFrame, key: list[str], order: str, digest: str) -> DataFrame:
    """Adds ``receipt``: the first batch of a key is accepted, an equal one a duplicate, another a conflict."""
    w = W.partitionBy(*key).orderBy(order)
    first = F.first(digest).over(w)
    state = F.when(F.row_number().over(w) == 1, "accepted").when(first.eqNullSafe(F.col(digest)), "duplicate").otherwise("conflict")
    return batches.withColumn("receipt", state)


def due(rows: DataFrame, status: str, available: str, now: Column, order: list[str], size: int) -> DataFrame:
    """The next ``size`` pending rows in the order of their due time."""
    return rows.where((F.col(status) == "pending") & (F.col(available) <= now)).orderBy(available, *order).limit(size)


def backoff(attempts: Column, base: int = 1, most: int = 60) -> Column:
    """Seconds to wait: doubled by each attempt, up to ``most``."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempts)).cast("long")


def test_vector(text: Column, width: int = 16) -> Column:
    """A deterministic bag-of-words vector of length 1, for tests without a model."""
    at = lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(width)).cast("int")
    counts = bound(F.transform(all_tokens(text), at), lambda s: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))
    return bound(counts, lambda v: bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def test_vectors(docs: DataFrame, key: str, text: str, width: int = 16) -> DataFrame:
    """(key, embedding): ``test_vector`` of every text; tasks hash a word once."""
    rows = docs.select(key, for_tokens(F.col(text)).alias("_text"))

    def run(batches):
        places = Numbers(lambda t: int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % width)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                n = np.array([np.bincount(places.of(words(t)), minlength=width) for t in part.column("_text").to_pylist()], dtype=np.float64)
                size = np.sqrt((n * n).sum(axis=1, keepdims=True))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, width, dtype=np.int32)), pa.array((n / np.where(size > 0, size, 1)).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), vectors], names=[key, "embedding"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<double>")
