"""Hybrid retrieval: branches that rank, fusion, merging to blocks, budgets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LEAST_TOKEN, SLOTS, STOP_WORDS, TEXTS, Numbers, for_tokens, slot_of, words
from ..session import MOST_BROADCAST, settled

#: Numbers in the query vectors that one pass holds.
PASS_NUMBERS = 4 << 20
#: Products that a task of ``dense`` holds at once, and rows that it gives back at once.
PASS_CELLS, OUT_ROWS = 2 << 20, 1 << 16
RRF_K = 60
WEIGHTS = {"dense": 1.0, "bm25": 1.5, "graph": 0.5}
BRANCH_TOP, REVIEW_PENALTY, GRAPH_SCORE, GRAPH_RANK = 30, 10, 0.5, 100


def postings(docs: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS, only: DataFrame | None = None) -> DataFrame:
    """(key, slot, weight): log1p of how often terms of a slot occur; with ``only`` (slot), of these slots."""
    rows = docs.select(key, for_tokens(F.col(text)).alias("_text"))
    slots = rows.mapInArrow(_counted(key, stop_words), f"`{key}` {rows.schema[key].dataType.simpleString()}, slot long, n long")
    if only is not None:  # before anything is shuffled
        slots = slots.join(only, "slot", "left_semi")
    return slots.groupBy(key, "slot").agg(F.sum("n").alias("tf")).select(key, "slot", F.log1p("tf").alias("weight"))


def _counted(key: str, stop_words: tuple[str, ...]):
    """A task's work in ``postings``: the slots of ``tokens`` and how often they occur, TEXTS texts at a time."""
    left_out = frozenset(stop_words)

    def run(batches):
        numbers = Numbers(lambda t: -1 if len(t) < LEAST_TOKEN or t in left_out else slot_of(t))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [numbers.of(words(t)) for t in part.column("_text").to_pylist()]
                slots = np.concatenate(found)
                own = np.repeat(np.arange(len(found)), [len(x) for x in found])
                each, n = np.unique((own * SLOTS + slots)[slots >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(each // SLOTS)), pa.array(each % SLOTS), pa.array(n)], names=[key, "slot", "n"])

    return run


def ranked(hits: DataFrame, query: str, score: str, tie: str, top: int) -> DataFrame:
    """Adds ``rank`` from 0 and keeps the first ``top`` of each query."""
    order = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie).asc())
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)


def bm25(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "item_id", text: str = "text", top: int = BRANCH_TOP) -> DataFrame:
    """(query, doc, score, rank): dot product of log1p frequencies times ln(1 + (N - df + 0.5) / (df + 0.5)).

    Up to MOST_BROADCAST weighed terms of queries go to all tasks, which multiply blocks of documents with all queries and give back each
    query's best of the block; more are joined by slot instead.
    """
    asked = settled(postings(queries, query_key, text).withColumnRenamed("weight", "q"))
    # what comes from the queries has at most as many rows as their postings: one count settles all joins
    few = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    small = F.broadcast if few else (lambda df: df)
    hit = settled(postings(docs, doc_key, text, only=small(asked.select("slot").distinct())))
    n = docs.count()
    idf = hit.groupBy("slot").agg(F.count("*").alias("df")).select("slot", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = asked.join(small(idf), "slot").select(query_key, "slot", (F.col("q") * F.col("idf")).alias("v"))
    if few:
        own = hit.where(F.col(doc_key).isNotNull()).groupBy(doc_key).agg(F.collect_list("slot").alias("slots"), F.collect_list("weight").alias("weights"))
        kinds = tuple(f.dataType.simpleString() for f in (asked.schema[query_key], docs.schema[doc_key]))
        keys = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, weighed.where(F.col(query_key).isNotNull()).collect())))
        scored = own.mapInArrow(_products(keys, query_key, doc_key, top), f"`{query_key}` {kinds[0]}, `{doc_key}` {kinds[1]}, score double")
        return ranked(scored.withColumn("score", F.round("score", 6)), query_key, "score", doc_key, top)
    scored = hit.join(weighed, "slot").groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("v") * F.col("weight")), 6).alias("score"))
    return ranked(scored, query_key, "score", doc_key, top)


def _products(terms, query_key: str, doc_key: str, top: int):
    """A task's work in ``bm25``: from (doc, slots, weights) the products with all queries, of which a query's ``top`` of a block and what is
    equal to the last of them but for rounding goes on."""

    def run(batches):
        queries = sorted({q for q, _, _ in terms.value})
        number = {q: i for i, q in enumerate(queries)}
        rows = sorted((s, number[q], v) for q, s, v in terms.value)
        slots, owner, value = (np.array([r[k] for r in rows], dtype=t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
        size = max(1, PASS_NUMBERS // max(len(queries), 1))
        keys = pa.array(queries)
        for batch in batches:
            for part in (batch.slice(at, size) for at in range(0, batch.num_rows, size)):
                own = part.column("slots")
                doc = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy())
                slot, weight = own.flatten().to_numpy(), part.column("weights").flatten().to_numpy()
                first, last = np.searchsorted(slots, slot), np.searchsorted(slots, slot, side="right")
                n = last - first
                score = np.zeros(part.num_rows * len(queries))
                for a in range(0, len(slot), 1 << 16):  # so many terms of documents at a time
                    m = n[a : a + (1 << 16)]
                    at = np.repeat(first[a : a + (1 << 16)] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    score += np.bincount(np.repeat(doc[a : a + (1 << 16)], m) * len(queries) + owner[at], np.repeat(weight[a : a + (1 << 16)], m) * value[at], len(score))
                table = score.reshape(part.num_rows, len(queries))
                least = np.partition(table, -top, axis=0)[-top] - 1e-6 if part.num_rows > top else np.full(len(queries), -1.0)
                d, q = np.nonzero((table > 0) & (table >= least))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(q)), part.column(doc_key).take(pa.array(d)), pa.array(table[d, q])], names=[query_key, doc_key, "score"])

    return run


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows; null numbers are NaN."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def dense(points: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = BRANCH_TOP, asking: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the ``top`` points by cosine for each query vector, ties by key.

    Query vectors of PASS_NUMBERS numbers are broadcast at a time; a task multiplies its points with them, PASS_CELLS products at once,
    carries the best of each query on and gives them back at its end. With the same key on both sides a point is left out of its own
    answer; ``asking`` names another key of the queries. A null or zero vector matches nothing.
    """
    spark = points.sparkSession
    asked = queries.select(F.col(asking or key).alias("query_id"), F.col(vector).alias("v")).where("query_id IS NOT NULL AND size(v) > 0")
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    passes = max(1, -(-n * (width or 1) // PASS_NUMBERS))
    rows = points.select(key, F.col(vector).alias("v")).where(F.col(key).isNotNull() & (F.size("v") > 0))
    kinds = asked.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    found = []
    for k in range(passes):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow().combine_chunks() if n else None
        sent = spark.sparkContext.broadcast((some["query_id"].combine_chunks(), _unit(_matrix(some["v"].combine_chunks()))) if some and some.num_rows else None)
        part = rows.mapInArrow(_best_of(sent, key, top, asking is None), f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
        found.append(settled(part) if passes > 1 else part)
    return ranked(reduce(DataFrame.unionByName, found), "query_id", "score", key, top)


def _best(query: np.ndarray, place: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Which of these hits are among the ``top`` of their query: by falling score, then by place; in the order of the queries."""
    order = np.lexsort((place, -score, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < top]


def _best_of(asked, key: str, top: int, same: bool):
    """A task's work in ``dense``: only products that reach the last of the ``top`` so far, but for rounding, are looked at."""

    def run(batches):
        if asked.value is None:
            for _ in batches:
                pass
            return
        ids, query = asked.value
        least = np.full(len(ids), -1.5)
        parts = []  # (query numbers, keys, scores): the best so far and what came since
        waiting = kept = 0
        size = max(1, PASS_CELLS // len(ids))

        def cut():
            q, value = (np.concatenate([x[k] for x in parts]) for k in (0, 2))
            names = pa.concat_arrays([x[1] for x in parts])
            place = np.empty(len(q), dtype=np.int64)
            place[pc.sort_indices(names).to_numpy()] = np.arange(len(q))
            stay = _best(q, place, value, top)
            n = np.bincount(q[stay], minlength=len(ids))
            full = n >= top
            least[full] = value[stay][np.cumsum(n)[full] - 1] - 1e-6
            parts[:] = [(q[stay], names.take(pa.array(stay)), value[stay])]
            return len(stay)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                keys, point = batch.column(key).slice(at, size), _unit(_matrix(batch.column("v").slice(at, size)))
                score = query @ point.T
                score[:, ~point.any(axis=1)] = -2
                score[~query.any(axis=1)] = -2
                if same:
                    own = pc.index_in(keys, value_set=ids)
                    mine = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                    score[own.drop_null().to_numpy(zero_copy_only=False), mine] = -2
                q, p = np.nonzero(score >= least[:, None])
                parts.append((q, keys.take(pa.array(p)), np.round(score[q, p], 6) + 0.0))
                waiting += len(q)
                if waiting > max(kept, PASS_CELLS // 8):  # so that what is kept is gone through seldom
                    kept, waiting = cut(), 0
        if parts:
            cut()
            q, names, value = parts[0]
            for at in range(0, len(q), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[part])), names.slice(at, OUT_ROWS), pa.array(value[part])], names=["query_id", key, "score"])

    return run


def composite(branches: dict[str, DataFrame], edges: DataFrame | None, query: str, key: str, top: int, per_branch: int = BRANCH_TOP, k: int = RRF_K, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query, key, score, place, limit_reached): ranked branches and the neighbours of their hits, fused and cut.

    edges: (key, neighbour). Neighbours are taken in the order of their keys, hits among them, ``per_branch`` for each query.
    limit_reached: the answer or some branch is as long as it may be.
    """
    hits = {name: df.where(F.col("rank") < per_branch) for name, df in branches.items()}
    if edges is not None:
        every = reduce(DataFrame.unionByName, [df.select(query, key) for df in hits.values()]).distinct()
        hits["graph"] = expand(every, edges, key, "neighbour", query, per_branch, fresh=False)
    hits = {name: settled(df.select(query, key, "rank")) for name, df in hits.items()}
    full = reduce(DataFrame.unionByName, [df.groupBy(query).agg((F.count("*") >= per_branch).alias("full")) for df in hits.values()])
    full = full.groupBy(query).agg(F.bool_or("full").alias("_full"))
    order = W.partitionBy(query).orderBy(F.col("score").desc(), key)
    out = fuse(hits, query, key, k, weights).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    long = out.groupBy(query).agg((F.count("*") >= top).alias("_long"))
    return out.join(full, query).join(long, query).select(query, key, "score", "place", (F.col("_full") | F.col("_long")).alias("limit_reached"))


def fuse(branches: dict[str, DataFrame], query: str, key: str, k: int = RRF_K, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query, key, score): reciprocal rank fusion of ranked branches, weight / (k + rank) added up."""
    parts = [df.select(query, key, (F.lit(weights[name]) / (k + F.col("rank"))).alias("part")) for name, df in branches.items()]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(query, key).agg(F.round(F.sum("part"), 9).alias("score"))


def demote(hits: DataFrame, flag: Column, penalty: int = REVIEW_PENALTY) -> DataFrame:
    return hits.withColumn("rank", F.col("rank") + F.when(flag, penalty).otherwise(0))


def expand(hits: DataFrame, edges: DataFrame, node: str, neighbour: str, query: str, top: int = BRANCH_TOP, fresh: bool = True) -> DataFrame:
    """Graph branch: neighbours of a query's hits in the order of their ids, score and rank fixed; with ``fresh`` those that
    are no hits themselves."""
    found = hits.select(query, node).join(edges.select(node, neighbour), node).select(query, F.col(neighbour).alias(node)).distinct()
    new = found.join(hits.select(query, node), [query, node], "left_anti") if fresh else found
    order = W.partitionBy(query).orderBy(node)
    new = new.withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") < top)
    return new.select(query, node, F.lit(GRAPH_SCORE).alias("score"), (GRAPH_RANK + F.col("_n")).alias("rank"))


def leaders(hits: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The best hit of each group."""
    order = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge_blocks(hits: DataFrame, group: list[str], key: str, score: str, review: Column) -> DataFrame:
    """One block a group: primary hit (reviews last, then by rank), siblings in that order, best score."""
    place = F.struct(review.cast("int").alias("r"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
    gathered = hits.groupBy(*group).agg(F.sort_array(F.collect_list(place)).alias("_all"), F.max(score).alias("score"))
    keys = F.transform("_all", lambda x: x["k"])
    return gathered.select(*group, F.element_at(keys, 1).alias("primary_id"), F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))).alias("siblings"), "score")


def budget(blocks: DataFrame, group: str, order: list[Column], size: Column, limit: int) -> DataFrame:
    """Blocks in order while what precedes them is below ``limit``; the block that crosses it stays."""
    before = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("used") < limit)


def by_best(hits: DataFrame, group: str, score: str) -> DataFrame:
    """Adds ``share``: the score over the best one of the group."""
    best = F.max(score).over(W.partitionBy(group))
    return hits.withColumn("share", F.when(best > 0, F.round(F.col(score) / best, 6)).otherwise(0.0))


def promote(hits: DataFrame, group: str, score: str, exact: Column) -> DataFrame:
    """Exact hits get the best score of the group on top of their own."""
    best = F.max(score).over(W.partitionBy(group))
    return hits.withColumn(score, F.col(score) + F.when(exact, best).otherwise(0.0))


def drop_unmatched(hits: DataFrame, group: str, matches: Column) -> DataFrame:
    """Where some hit of the group matches, hits that do not go."""
    some = F.max(matches.cast("int")).over(W.partitionBy(group))
    return hits.withColumn("_some", some).where((F.col("_some") == 0) | matches).drop("_some")


def gains(ranked_hits: DataFrame, query: str, relevant: Column, total: DataFrame, k: int) -> DataFrame:
    """(query, ndcg, recall) at k, with 0/1 relevance; total: (query, n) relevant points there are."""
    gain = F.when(relevant, 1.0 / F.log2(F.col("rank") + 2)).otherwise(0.0)
    got = ranked_hits.where(F.col("rank") < k).groupBy(query).agg(F.sum(gain).alias("dcg"), F.sum(relevant.cast("int")).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return got.join(total, query).where("n > 0").select(query, F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.col("hits") / F.col("n"), 6).alias("recall"))
