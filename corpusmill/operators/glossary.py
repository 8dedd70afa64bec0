"""Glossary: terms found in queries, overlaps resolved, queries expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens, bound, normalise
from ..session import few

MOST_TERMS, MOST_ALIASES = 5, 4


def forms(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(form, term_id, can_search, can_expand): names and aliases of terms, rights merged where forms agree."""
    both = terms.select("term_id", F.col("name").alias("form"), F.lit(True).alias("can_search"), F.lit(True).alias("can_expand")).unionByName(
        aliases.select("term_id", F.col("alias").alias("form"), "can_search", "can_expand")
    )
    key = F.array_join(all_tokens(normalise(F.col("form"))), " ").alias("form")
    return both.select("term_id", key, "can_search", "can_expand").where("form <> ''").groupBy("form", "term_id").agg(
        F.bool_or("can_search").alias("can_search"), F.bool_or("can_expand").alias("can_expand")
    )


def mentions(queries: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term_id, form, start, size): token spans of a query that are a searchable form, longest first, none overlapping."""
    searched = known.where("can_search")
    # n-grams as long as the forms are, whatever their length
    lengths = searched.agg(F.array_sort(F.collect_set(F.size(F.split("form", " ")))).alias("lengths"))
    words = queries.select(key, all_tokens(F.col(text)).alias("w")).crossJoin(F.broadcast(lengths))
    grams = lambda w: F.flatten(
        F.transform(
            F.col("lengths"),
            lambda n: F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: i + n - 1 <= F.size(w)),
                lambda i: F.struct(i.alias("start"), n.alias("size"), F.array_join(F.slice(w, i, n), " ").alias("form")),
            ),
        )
    )
    found = words.select(key, F.inline(bound(F.col("w"), grams))).join(few(searched), "form")
    # longest, then leftmost, then least id; a taken span bars all that overlap it
    order = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "start", "term_id", "size", "form")))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["start"] < x["start"] + x["size"]) & (x["start"] < t["start"] + t["size"]))
    gathered = found.groupBy(key).agg(order.alias("c"))
    taken = F.aggregate("c", F.filter("c", lambda x: F.lit(False)), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return gathered.select(key, F.inline(taken)).select(key, "term_id", "form", "start", "size")


def expansions(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, term_id, added): other forms of the first terms of each query, at most MOST_ALIASES for each term."""
    other = few(known.where("can_expand").select("term_id", F.col("form").alias("added")))
    pairs = found.select(key, "term_id", "form").join(other, "term_id").where("added <> form").distinct()
    listed = pairs.groupBy(key, "term_id").agg(F.slice(F.array_sort(F.collect_set("added")), 1, MOST_ALIASES).alias("a"))
    terms = listed.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("term_id", "a"))), 1, MOST_TERMS).alias("t"))
    return terms.select(key, F.inline("t")).select(key, "term_id", F.explode("a").alias("added"))


def expanded_vector(original: DataFrame, added: DataFrame, key: str, scale: float = 0.5) -> DataFrame:
    """(key, slot, weight): original weights stay, slots that only the expansion has come in scaled."""
    new = added.join(original.select(key, "slot"), [key, "slot"], "left_anti").groupBy(key, "slot").agg((F.max("weight") * scale).alias("weight"))
    return original.select(key, "slot", "weight").unionByName(new)


def numbered(queries: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule_id, number): numbers of four digits behind a rule's prefix, within the rule's bounds."""
    words = queries.select(key, F.explode(all_tokens(F.col(text))).alias("w"))
    parts = words.select(key, F.regexp_extract("w", r"^([a-zа-я]+)[0-9]{4}$", 1).alias("prefix"), F.regexp_extract("w", r"([0-9]{4})$", 1).try_cast("int").alias("number"))
    return parts.where("number IS NOT NULL").join(few(rules), "prefix").where("number BETWEEN low AND high").select(key, "rule_id", "number").distinct()


def clashes(known: DataFrame) -> DataFrame:
    """(a, b, form): pairs of terms that share a form."""
    left, right = known.select(F.col("term_id").alias("a"), "form"), known.select(F.col("term_id").alias("b"), "form")
    return left.join(right, "form").where("a < b")
