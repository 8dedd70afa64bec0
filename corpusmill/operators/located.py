"""Fragments by content and places of results: what is shown is verified against what was indexed, and falls back where it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound
from .chunks import FRAGMENT_BYTES, fragments
from .evidence import unique_quote

#: Fixed value: places that a result may name in its chunk.
MOST_SPANS = 3


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def indexed(chunks: DataFrame, key: list[str], text: str, limit: int = FRAGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """((key, ordinal, hash, pieces, chunk_hash), (hash, fragment)): the fragments of each chunk by their hashes, and each content once. A null or
    empty chunk is one empty fragment."""
    known = chunks.select(F.struct(F.struct(*key).alias("key"), digest(F.col(text)).alias("chunk_hash")).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    cut = fragments(known, "_key", "_text", limit).withColumn("hash", digest(F.col("fragment")))
    names = cut.select("_key.key.*", F.col("ordinal").cast("long").alias("ordinal"), "hash", "_key.chunk_hash")
    pieces = F.count("*").over(W.partitionBy(*key))
    table = names.select(*key, "ordinal", "hash", pieces.alias("pieces"), "chunk_hash")
    return table, cut.select("hash", "fragment").dropDuplicates(["hash"])


def _met(table: DataFrame, contents: DataFrame, value: Column) -> DataFrame:
    """The table with ``_v``, a value of each content that has its hash; null where there is none."""
    sound = contents.where(digest(F.col("fragment")) == F.col("hash")).select("hash", value.alias("_v"))
    return table.join(sound.dropDuplicates(["hash"]), "hash", "left")


def _listed(met: DataFrame, key: list[str], *more: str) -> DataFrame:
    """(key, chunk_hash, _fit, _f): the fragments of each chunk in order, and whether all of them are there once."""
    one = met.groupBy(*key).agg(
        F.max("chunk_hash").alias("chunk_hash"), (F.min("chunk_hash") == F.max("chunk_hash")).alias("_same"), F.max("pieces").alias("_pieces"), F.count("_v").alias("_found"), F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.struct("ordinal", "_v", *more))).alias("_f"),  # of one chunk
    )
    in_order = F.transform("_f", lambda x: x["ordinal"]) == F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    fit = F.col("_same") & (F.col("_pieces") == F.col("_n")) & (F.col("_found") == F.col("_n")) & in_order
    return one.select(*key, "chunk_hash", F.coalesce(fit, F.lit(False)).alias("_fit"), "_f")


def verified(table: DataFrame, contents: DataFrame, key: list[str]) -> DataFrame:
    """(key, chunk_hash, whole): whether all fragments of a chunk are there once, have the content of their hash, and make up the chunk."""
    joined = F.array_join(F.transform("_f", lambda x: F.coalesce(x["_v"], F.lit(""))), "")
    whole = F.col("_fit") & (digest(joined) == F.col("chunk_hash"))
    return _listed(_met(table, contents, F.col("fragment")), key).select(*key, "chunk_hash", F.coalesce(whole, F.lit(False)).alias("whole"))


def hydrated(hits: DataFrame, table: DataFrame, contents: DataFrame, chunks: DataFrame, key: list[str], text: str) -> DataFrame:
    """Hits (key, ordinal, ...) with ``basis`` and ``shown``: the fragment where its chunk is verified and still has the content that was
    indexed, else the chunk as it is now ("chunk"), else nothing ("gone").

    A chunk that is as it was indexed holds its fragments itself: contents bring their sizes only, and the chunk, cut at these sizes, has to
    have the hashes of the table. So each text moves once, to its key, before it meets the hits.
    """
    ends = F.sum("_v").over(W.partitionBy(*key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow))
    state = _listed(_met(table, contents, F.octet_length("fragment")).withColumn("_end", ends), key, "_end", "hash")
    now = chunks.select(*key, F.coalesce(text, F.lit("")).alias("_now"), F.lit(True).alias("_there"))
    still = F.col("_fit") & (digest(F.col("_now")) == F.col("chunk_hash")) & (F.element_at("_f", -1)["_end"] == F.octet_length("_now"))
    piece = lambda raw, x: F.substring(raw, (x["_end"] - x["_v"] + 1).cast("int"), x["_v"])
    cut = bound(F.col("_now").cast("binary"), lambda raw: F.transform("_f", lambda x: F.struct(x["hash"].alias("hash"), piece(raw, x).alias("piece"))))
    placed = now.join(state, key, "left").select(*key, "_there", "_now", F.when(still, cut).alias("_cut"))
    sound = F.forall("_cut", lambda x: F.sha2(x["piece"], 256) == x["hash"])
    placed = placed.select(*key, "_there", "_now", F.when(sound, F.transform("_cut", lambda x: x["piece"].cast("string"))).alias("_pieces"))
    out = hits.join(placed, key, "left")
    at = F.when(F.col("ordinal").between(0, F.size("_pieces") - 1), F.col("ordinal")).cast("int")
    own = F.get("_pieces", at)
    basis = F.when(own.isNotNull(), "fragment").when(F.col("_there"), "chunk").otherwise("gone")
    return out.select(*hits.columns, basis.alias("basis"), F.when(own.isNotNull(), own).otherwise(F.col("_now")).alias("shown"))


def references(hits: DataFrame, chunks: DataFrame, active: DataFrame, key: list[str], doc: str, text: str, excerpt: str) -> DataFrame:
    """Hits (key, generation, excerpt, ...) with ``basis``, ``chunk_hash`` and ``spans``: where the excerpt stands in its chunk once, as a whole,
    MOST_SPANS at most. Without such a place, or if the hit's generation is not the active one of its document, the whole
    chunk is meant; a hit without its chunk has no place at all (null basis)."""
    now = chunks.select(*key, F.col(text).alias("_now"))
    live = active.select(doc, F.col("generation").alias("_live"))
    out = hits.join(now, key, "left").join(live, doc, "left")
    quote = unique_quote(F.col("_now"), F.col(excerpt))
    kind = "array<struct<start:bigint,end:bigint>>"
    spans = F.when(F.col("generation").eqNullSafe(F.col("_live")) & quote.isNotNull(), F.array(quote)).cast(kind)
    spans = F.slice(F.coalesce(spans, F.array().cast(kind)), 1, MOST_SPANS)
    there = F.col("_now").isNotNull()
    basis = F.when(~there, None).when(F.size(spans) > 0, "match").otherwise("chunk")
    return out.select(*hits.columns, basis.alias("basis"), F.when(there, digest(F.col("_now"))).alias("chunk_hash"), spans.alias("spans"))


def resolved(refs: DataFrame, chunks: DataFrame, active: DataFrame, key: list[str], doc: str, text: str) -> DataFrame:
    """References (key, generation, basis, chunk_hash, spans, ...) against the present: another generation or content makes them the whole chunk without
    places, a lost chunk makes them "gone"."""
    now = chunks.select(*key, digest(F.col(text)).alias("_digest"))
    out = refs.join(now, key, "left").join(active.select(doc, F.col("generation").alias("_live")), doc, "left")
    same = F.coalesce((F.col("_digest") == F.col("chunk_hash")) & (F.col("generation") == F.col("_live")), F.lit(False))
    basis = F.when(F.col("_digest").isNull(), "gone").when(same, F.col("basis")).otherwise("chunk")
    spans = F.when(same, F.col("spans")).otherwise(F.slice("spans", 1, 0))
    return out.select(*[basis.alias(c) if c == "basis" else spans.alias(c) if c == "spans" else F.col(c) for c in refs.columns])
