"""What a search may see: scopes, generations, visibility, current versions, and the orders of listings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import glob
from ..session import DEALT_ROWS, dealt, settled
from .catalogue import all_of, any_of, any_tag, in_locales

#: What a search does with mail.
MAIL_MODES = ("all", "exclude", "only")


def mail_allowed(scope: Column, mode: str) -> Column:
    """Whether a source of this scope (mail, document, unknown) may be seen; what is unknown, or null, passes in mode "all" alone."""
    if mode not in MAIL_MODES:
        raise ValueError(f"no mail mode {mode}")
    return F.lit(True) if mode == "all" else F.coalesce(scope == ("mail" if mode == "only" else "document"), F.lit(False))


def prefilter(
    *, tags: tuple[list[Column], list[str]] | None = None, locale: Column | None = None, locales: tuple[str, ...] = (), unknown: bool = False,
    mail: tuple[Column, str] | None = None, doc_ids: tuple[Column, list] | None = None, deleted: Column | None = None,
) -> Column:
    """The condition that holds before anything is scored: any of the tags, a locale, the mail scope, given documents, none deleted."""
    return all_of([
        any_tag(*tags) if tags and tags[1] else None,
        in_locales(locale, list(locales), unknown) if locale is not None else None,
        mail_allowed(*mail) if mail else None,
        doc_ids[0].isin(*doc_ids[1]) if doc_ids else None,
        ~F.coalesce(deleted, F.lit(False)) if deleted is not None else None,
    ])


def shown(points: DataFrame, generations: DataFrame, removed: DataFrame) -> DataFrame:
    """Points (doc_id, generation_id, ...) of no hidden generation: inactive or removed ones are hidden, and points without a
    generation where an old one of their document still waits for its clean-up."""
    hidden = generations.where("phase <> 'active'").select("generation_id").unionByName(removed.select("generation_id")).distinct()
    waiting = generations.where("cleanup_pending").select("doc_id").distinct().withColumn("_waits", F.lit(True))
    out = points.join(hidden, "generation_id", "left_anti").join(waiting, "doc_id", "left")
    return out.where("NOT (coalesce(_waits, false) AND generation_id IS NULL)").select(*points.columns)


def current(hits: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """Hits (doc_id, generation_id, ...) of documents that are there and whose active generation is the hit's, null with null."""
    alive = docs.where("NOT coalesce(deleted, false)").select("doc_id").join(state.select("doc_id", "active_generation_id"), "doc_id", "left")
    return hits.join(alive, "doc_id").where(F.col("generation_id").eqNullSafe(F.col("active_generation_id"))).select(*hits.columns)


def proven(block: dict[str, Column], components: Column, keys: list[str], mode: str) -> Column:
    """Whether a block is verified, in scope, and made of components that all are so too and agree with it in ``keys``."""
    if mode == "all":
        return F.lit(True)
    agrees = lambda c: all_of([F.coalesce(c["verified"], F.lit(False)), mail_allowed(c["scope"], mode), *[c[k].eqNullSafe(block[k]) for k in keys]])
    return all_of([
        F.coalesce(block["verified"], F.lit(False)), mail_allowed(block["scope"], mode),
        F.coalesce(F.size(components) > 0, F.lit(False)), F.coalesce(F.forall(components, agrees), F.lit(False)),
    ])


def published(docs: DataFrame, state: DataFrame, *parts: DataFrame) -> DataFrame:
    """(doc_id) of documents not deleted that have an active generation, are done, or have a row in one of ``parts``."""
    alive = docs.where("NOT coalesce(deleted, false)")
    known = [alive.where("status = 'done'").select("doc_id"), state.where("active_generation_id IS NOT NULL").select("doc_id"), *[p.select("doc_id") for p in parts]]
    return alive.select("doc_id").join(reduce(DataFrame.unionByName, known).distinct(), "doc_id", "left_semi").distinct()


def versions_seen(heads: DataFrame, versions: DataFrame, user, scope: str = "all", asked: str = "") -> DataFrame:
    """Heads (id, owner_id, visibility, current_version, ...) with their current version (id, version, name, description), as far
    as the user may see them and name or description hold the text."""
    mine, public = F.col("owner_id") == user, F.col("visibility") == "public"
    may = {"all": mine | public, "mine": mine, "public": public}[scope]
    rows = heads.where(may).join(versions.withColumnRenamed("version", "current_version"), ["id", "current_version"])
    text = asked.strip()
    return rows.where(F.lower("name").contains(text.lower()) | F.lower(F.coalesce("description", F.lit(""))).contains(text.lower())) if text else rows


def searched(docs: DataFrame, asked: str, name: str, fields: list[str], links: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Documents whose name fits a glob or holds the text, or one of whose fields, or of whose linked rows' fields, holds it.
    links: (rows, key, fields); a row of ``docs`` stays one row however many links fit."""
    text = asked.strip()
    if not text:
        return docs
    holds = lambda c: F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    own = F.coalesce(glob(F.col(name), text), F.lit(False)) | any_of([holds(f) for f in fields])
    out, marks = docs, []
    for k, (rows, key, columns) in enumerate(links):
        fit = rows.where(any_of([holds(c) for c in columns])).select(F.col(key).alias(key)).distinct().withColumn(f"_fit{k}", F.lit(True))
        out = out.join(fit, key, "left")
        marks.append(F.coalesce(f"_fit{k}", F.lit(False)))
    return out.where(any_of([own, *marks])).select(*docs.columns)


def listing(order: str, columns: dict[str, str], created: str, trash: str | None = None) -> list[Column]:
    """Sort columns of a listing named "<key>_asc" or "<key>_desc": nulls last, the newest first among equals; of a trash, the
    latest deletion first."""
    key, _, way = order.rpartition("_")
    c = F.col(columns[key])
    by = c.asc_nulls_last() if way == "asc" else c.desc_nulls_last()
    return [*([F.col(trash).desc_nulls_last()] if trash else []), by, F.col(created).desc_nulls_last()]


def developments(rows: DataFrame, asked: str | None = None, module: str | None = None, none: str = "__none__") -> DataFrame:
    """Rows whose number starts with the text or whose name holds it; ``none`` asks for rows without a module."""
    text = F.col("number").startswith(asked) | F.lower("name").contains(asked.lower()) if asked else None
    wanted = None if module is None else F.col("module").isNull() if module == none else F.col("module") == module
    return rows.where(all_of([text, wanted]))


def logged(rows: DataFrame, at: str, since=None, until=None, **equal) -> DataFrame:
    """Rows within the bounds, both included, that have the given values."""
    return rows.where(all_of([F.col(at) >= since if since is not None else None, F.col(at) <= until if until is not None else None, *[F.col(c) == v for c, v in equal.items() if v is not None]]))


def day_bound(text: Column, end: bool) -> Column:
    """Start or last microsecond of a day written YYYY-MM-DD; null for anything else."""
    day = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd")))
    return day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND") if end else day


def resolved_tags(asked: DataFrame, tags: DataFrame, translations: DataFrame) -> DataFrame:
    """(text, locale, tag_id): the least tag that has the text in the locale, else the one whose own text it is."""
    rows = asked.select("text", "locale").distinct().withColumn("_t", F.trim("text")).where("_t <> ''")
    local = translations.groupBy(F.col("text").alias("_t"), "locale").agg(F.min("tag_id").alias("_local"))
    own = tags.groupBy(F.col("canonical_text").alias("_t")).agg(F.min("tag_id").alias("_own"))
    return rows.join(local, ["_t", "locale"], "left").join(own, "_t", "left").select("text", "locale", F.coalesce("_local", "_own").alias("tag_id"))


def displayed(terms: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """(term_id, name, locale, is_fallback): the translation made from the term's present revision, else the original name."""
    fresh = translations.where(F.col("locale") == locale).select("term_id", "display_name", F.col("source_revision").alias("_r"))
    fresh = fresh.groupBy("term_id", "_r").agg(F.min("display_name").alias("display_name"))
    joined = terms.join(fresh.withColumnRenamed("term_id", "_term"), (F.col("term_id") == F.col("_term")) & (F.col("source_revision") == F.col("_r")), "left")
    own = F.col("canonical_locale") == locale
    other = ~own & F.col("display_name").isNotNull()
    return joined.select(
        "term_id", F.when(other, F.col("display_name")).otherwise(F.col("original_name")).alias("name"),
        F.when(other, locale).otherwise(F.col("canonical_locale")).alias("locale"), (~own & ~other).alias("is_fallback"),
    )


def stop_words(words: DataFrame, locales: DataFrame) -> DataFrame:
    """(word): each word of an active locale, once."""
    return words.join(locales.where("is_active").select("locale"), "locale", "left_semi").select("word").distinct()


def merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, ...) with the merged range that holds them: a range meets the places of its own rows only, each place
    once, and cells meet the ranges of their own place. Cells are dealt out by place to as many tasks as the rows of the result need."""
    rows = merges.select("sheet", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right", "merge_id")
    place = ["sheet", "row", "col"]
    places = cells.groupBy(*place).agg(F.count("*").alias("_n"))
    held = settled(places.join(rows, ["sheet", "row"]).where("col BETWEEN left AND right").select(*place, "merge_id", "_n"))
    pairs, n = held.agg(F.sum("_n"), F.count_distinct(*place)).first()
    return dealt(cells, min(pairs or 0, n * DEALT_ROWS), *place).join(held.drop("_n").hint("merge"), place).select(*cells.columns, "merge_id")


def display_order(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, source_id, chunk_index, local_order) with ``display_order``: by the place of their source in a depth-first walk,
    siblings in their order; sources: (source_id, path), path holding the (ordinal, key) of each step from the root."""
    order = [F.col("path").asc(), F.coalesce("local_order", "chunk_index").asc()]
    at = F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.join(sources.select("source_id", "path"), "source_id").withColumn("display_order", at).drop("path")


def first_seen(lists: list[DataFrame], key: str, score: str, most: int) -> DataFrame:
    """(key, place, score): the lists one behind the other, each by falling score, every key at its first place, ``most`` in all."""
    each = [x.select(key, score).orderBy(F.col(score).desc(), key).limit(most).withColumn("_list", F.lit(k)) for k, x in enumerate(lists)]
    ranked = reduce(DataFrame.unionByName, each)
    place = F.struct("_list", (-F.col(score)).alias("_s"), key)
    firsts = ranked.groupBy(key).agg(F.min(place).alias("_p")).orderBy("_p").limit(most)
    at = F.row_number().over(W.orderBy("_p")) - 1  # of ``most`` rows
    return firsts.select(key, at.alias("place"), (-F.col("_p._s")).alias(score))


def ancestor_least(nodes: DataFrame, keys: list[str], node: str, parent: str, value: str) -> DataFrame:
    """(keys, node, least): the least value of each node and all above it; null for a node that hangs in or under a circle.

    Pointers are doubled: each round a node takes the least of where it points and points twice as far, so a tree takes as many
    rounds as its depth has bits. A parent that is not there ends the way.
    """
    known = nodes.select(*keys, F.col(node).alias("_n"))
    linked = nodes.select(*keys, F.col(node).alias("node"), F.col(value).alias("least"), F.col(parent).alias("_n")).join(known.withColumn("_is", F.lit(True)), [*keys, "_n"], "left")
    state = settled(linked.select(*keys, "node", "least", F.when(F.col("_is"), F.col("_n")).alias("to")))
    most, reach = state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0, 1
    while reach < most and not state.where("to IS NOT NULL").isEmpty():
        above = state.select(*keys, F.col("node").alias("to"), F.col("least").alias("_l"), F.col("to").alias("_t"))
        state = settled(state.join(above, [*keys, "to"], "left").select(*keys, "node", F.least("least", "_l").alias("least"), F.col("_t").alias("to")))
        reach *= 2
    return state.select(*keys, "node", F.when(F.col("to").isNull(), F.col("least")).alias("least"))


def recommended(nodes: DataFrame, keys: list[str], node: str, parent: str, barred: str, metrics: dict[str, int]) -> DataFrame:
    """(keys, node, included, reason): a scope whose totals all stay below their limits. metrics: limit by column.

    A node with a reason in ``barred`` goes with all below it. While a total reaches its limit, the node that holds the largest share
    of a limit goes (ties: the least node), with all below it: "aggregate_budget". Others that go are "ancestor_excluded", those that stay
    "small". The order of going does not depend on what went before, so a node goes in the turn of the earliest of itself and those
    above, totals after each turn are sums over all later turns, and the first turn after which all fit ends it.
    """
    share = F.greatest(F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0)) / limit for c, limit in metrics.items()])
    marked = settled(nodes.select(*keys, F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(barred).alias("_why"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in metrics], share.alias("_share")))
    open_ = ancestor_least(marked.withColumn("_open", F.when(F.col("_why").isNull(), 1).otherwise(0)), keys, "node", "parent", "_open").where("least = 1").select(*keys, "node")
    candidates = marked.join(open_, [*keys, "node"])
    ranked = settled(candidates.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_share"), "node"))))
    turns = ancestor_least(ranked, keys, "node", "parent", "turn").withColumnRenamed("least", "goes")
    placed = ranked.join(turns, [*keys, "node"])
    each = placed.groupBy(*keys, "goes").agg(*[F.sum(c).alias(c) for c in metrics])
    # later turns stand in front here: a frame up to the end is summed anew for each row, one from the start is carried on
    later = W.partitionBy(*keys).orderBy(F.desc("goes")).rowsBetween(W.unboundedPreceding, -1)
    fits = reduce(and_, [F.coalesce(F.sum(c).over(later), F.lit(0)) < limit for c, limit in metrics.items()])
    whole = reduce(and_, [F.sum(c) < limit for c, limit in metrics.items()])
    last = each.withColumn("fits", fits).groupBy(*keys).agg(F.min(F.when(F.col("fits"), F.col("goes"))).alias("last"), F.when(whole, 0).alias("none"))
    judged = placed.join(last.select(*keys, F.coalesce("none", "last").alias("last")), keys).select(*keys, "node", "turn", "goes", "last")
    reason = F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("goes").isNull(), "ancestor_excluded").when(F.col("goes") > F.col("last"), "small")
    reason = reason.when(F.col("turn") == F.col("goes"), "aggregate_budget").otherwise("ancestor_excluded")
    return marked.join(judged, [*keys, "node"], "left").select(*keys, "node", F.coalesce(F.col("goes") > F.col("last"), F.lit(False)).alias("included"), reason.alias("reason"))
