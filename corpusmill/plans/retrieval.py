"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge as K
from ..operators import retrieval as R
from ..session import settled, table

TOKENS = "list_filter(regexp_extract_all(replace(lower(coalesce({t}, '')), chr(775), ''), '[a-zа-яё0-9ßà-öø-ÿā-žșț]+'), lambda t: length(t) >= 2 AND NOT list_contains([{stop}], t))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens(t: str) -> str:
    return TOKENS.format(t=t, stop=_STOP)


_SLOT = "('0x' || substr(md5(term), 7, 2) || substr(md5(term), 5, 2) || substr(md5(term), 3, 2) || substr(md5(term), 1, 2))::BIGINT % 1048576"


def _postings(name: str, source: str, key: str) -> str:
    return f"""{name}_terms AS (SELECT {key}, unnest({_tokens('text')}) AS term FROM {source}),
{name} AS (SELECT {key}, slot, ln(1 + count(*)) AS weight FROM (SELECT {key}, {_SLOT} AS slot FROM {name}_terms) GROUP BY {key}, slot)"""


_BM25 = f"""{_postings('d', 'documents', 'doc_id')}, {_postings('q', 'benchmark', 'item_id')},
idf AS (SELECT slot, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d GROUP BY slot),
scored AS (SELECT item_id, doc_id, round(sum(q.weight * d.weight * idf), 6) AS score FROM q JOIN d USING (slot) JOIN idf USING (slot) GROUP BY item_id, doc_id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored QUALIFY rank < 30)"""
_DENSE = """pairs AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, q.label AS query_label,
  round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings p JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON p.vec_id <> q.vec_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM pairs QUALIFY rank < 30)"""


_VEC = """{name}_terms AS (SELECT {key}, unnest(regexp_extract_all(replace(lower(coalesce(text, '')), chr(775), ''), '[a-zа-яё0-9ßà-öø-ÿā-žșț]+')) AS t FROM {source}),
{name}_n AS (SELECT {key}, ('0x' || substr(md5(t), 1, 7))::BIGINT % 16 AS i, count(*)::DOUBLE AS n FROM {name}_terms GROUP BY ALL),
{name} AS (SELECT {key}, i, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}_n)"""
_FUSED = f"""{_VEC.format(name='dv', key='doc_id', source='documents')}, {_VEC.format(name='qv', key='item_id', source='benchmark')},
near AS (SELECT item_id, doc_id, round(sum(dv.x * qv.x), 6) AS score FROM qv JOIN dv USING (i) GROUP BY item_id, doc_id),
all_pairs AS (SELECT item_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT item_id FROM qv) CROSS JOIN (SELECT DISTINCT doc_id FROM dv) LEFT JOIN near USING (item_id, doc_id)),
vec AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM all_pairs QUALIFY rank < 30),
link AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS neighbour FROM documents),
reached AS (SELECT DISTINCT item_id, neighbour AS doc_id FROM (SELECT item_id, doc_id FROM vec UNION SELECT item_id, doc_id FROM bm25) JOIN link USING (doc_id) WHERE neighbour IS NOT NULL),
graph AS (SELECT item_id, doc_id, 99 + row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM reached QUALIFY rank < 130),
hits AS (SELECT 'dense' AS branch, item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM vec UNION ALL SELECT 'bm25', item_id, doc_id, 1.5::DOUBLE / (60 + rank) FROM bm25
UNION ALL SELECT 'graph', item_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM graph),
fused AS (SELECT item_id, doc_id, round(sum(part), 9) AS score FROM hits GROUP BY item_id, doc_id)"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", T.tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.size("t")).alias("tokens"), F.sum(F.size(F.array_distinct("t"))).alias("distinct_tokens")
    )


def sparse_vector(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "slot", F.round("weight", 6).alias("weight"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense(table(spark, d, "embeddings"), _asked(spark, d)).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def _branches(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Word hits and hits by test vectors of the documents for each benchmark item, and links to the next document of a source."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    points, asked = K.test_vectors(docs, "doc_id", "text"), K.test_vectors(items, "item_id", "text")
    hits = R.dense(points, asked, key="doc_id", asking="item_id").withColumnRenamed("query_id", "item_id")
    after = F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id"))
    edges = docs.select("doc_id", after.alias("neighbour")).where("neighbour IS NOT NULL")
    # what follows reads them more than once
    return {"dense": settled(hits), "bm25": settled(R.bm25(docs, items))}, edges


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """All three branches fused."""
    hits, edges = _branches(spark, d)
    every = hits["dense"].select("item_id", "doc_id").unionByName(hits["bm25"].select("item_id", "doc_id")).distinct()
    return R.fuse(hits | {"graph": R.expand(every, edges, "doc_id", "neighbour", "item_id", fresh=False)}, "item_id", "doc_id")


def composite_search(spark: SparkSession, d: str) -> DataFrame:
    hits, edges = _branches(spark, d)
    out = R.composite(hits, edges, "item_id", "doc_id", top=20)
    return out.select("item_id", "doc_id", "score", F.col("place").cast("long").alias("place"), "limit_reached")


def review_demotion(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("review"))
    hits = R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")).join(flagged, "doc_id", "left")
    return R.fuse({"bm25": R.demote(hits, F.coalesce("review", F.lit(False)))}, "item_id", "doc_id")


def fragment_leader(spark: SparkSession, d: str) -> DataFrame:
    return R.leaders(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a customer's orders lead to."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    hits = table(spark, d, "orders").select("o_custkey", name("o", "o_orderkey").alias("node"))
    edges = table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("node"), name("p", "l_partkey").alias("neighbour"))
    return R.expand(hits, edges, "node", "neighbour", "o_custkey").select("o_custkey", "node", F.col("rank").cast("long").alias("rank"))


def merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = R.merge_blocks(docs, ["source", "lang"], "doc_id", "n_chars", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return out.select("source", "lang", "primary_id", F.array_join("siblings", ",").alias("siblings"), "score")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return R.budget(docs, "source", [F.col("n_chars").desc(), F.col("doc_id")], F.col("n_chars"), 32000)


def score_normalise(spark: SparkSession, d: str) -> DataFrame:
    return R.by_best(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars").select("source", "doc_id", "share")


def exact_promotion(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_type", "p_retailprice")
    out = R.promote(parts, "p_brand", "p_retailprice", F.col("p_type").ilike("%promo%"))
    return out.select("p_brand", "p_partkey", F.round("p_retailprice", 4).alias("score"))


def unmatched_dropped(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_type")
    return R.drop_unmatched(parts, "p_brand", F.col("p_type").ilike("%promo%"))


def ndcg_recall(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings")
    asked = _asked(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    hits = R.dense(points, _asked(spark, d), top=10).join(points.select("vec_id", "label"), "vec_id").join(asked, "query_id")
    sizes = points.groupBy("label").agg(F.count("*").alias("c"))
    total = asked.join(sizes, F.col("label") == F.col("query_label")).select("query_id", (F.col("c") - 1).alias("n"))
    return R.gains(hits, "query_id", F.col("label") == F.col("query_label"), total, 10)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, token_stats, sparse_vector, dense_topk, rrf_fusion, composite_search, review_demotion, fragment_leader, graph_expansion, merge_blocks,
        context_budget, score_normalise, exact_promotion, unmatched_dropped, ndcg_recall,
    )
}

ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bm25",
    "token_stats": f"""SELECT lang, count(*) AS docs, sum(len(t))::BIGINT AS tokens, sum(len(list_distinct(t)))::BIGINT AS distinct_tokens
FROM (SELECT lang, {_tokens('text')} AS t FROM documents) GROUP BY lang""",
    "sparse_vector": f"WITH {_postings('d', 'documents', 'doc_id')} SELECT doc_id, slot, round(weight, 6) AS weight FROM d",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM dense",
    "rrf_fusion": f"""WITH {_BM25}, {_FUSED} SELECT item_id, doc_id, score FROM fused""",
    "composite_search": f"""WITH {_BM25}, {_FUSED},
cut AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM fused QUALIFY place <= 20),
most AS (SELECT item_id, max(n) AS n FROM (SELECT item_id, branch, count(*) AS n FROM hits GROUP BY ALL) GROUP BY item_id)
SELECT item_id, doc_id, score, place, (most.n >= 30 OR count(*) OVER (PARTITION BY item_id) >= 20) AS limit_reached FROM cut JOIN most USING (item_id)""",
    "review_demotion": f"""WITH {_BM25} SELECT item_id, bm25.doc_id, round(1.5::DOUBLE / (60 + rank + CASE WHEN toxic = 1 THEN 10 ELSE 0 END), 9) AS score
FROM bm25 LEFT JOIN labels USING (doc_id)""",
    "fragment_leader": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
    "graph_expansion": """SELECT o_custkey, node, 99 + row_number() OVER (PARTITION BY o_custkey ORDER BY node) AS rank
FROM (SELECT DISTINCT o_custkey, 'p' || l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey) QUALIFY rank < 130""",
    "merge_blocks": """WITH d AS (SELECT source, lang, documents.doc_id, n_chars,
row_number() OVER (PARTITION BY source, lang ORDER BY CASE WHEN toxic = 1 THEN 1 ELSE 0 END, n_chars DESC, documents.doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, lang, min(doc_id) FILTER (n = 1) AS primary_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY n) FILTER (n > 1), '') AS siblings, max(n_chars) AS score
FROM d GROUP BY source, lang""",
    "context_budget": """SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
FROM documents QUALIFY used < 32000""",
    "score_normalise": "SELECT source, doc_id, round(n_chars::DOUBLE / max(n_chars) OVER (PARTITION BY source), 6) AS share FROM documents",
    "exact_promotion": """SELECT p_brand, p_partkey, round(p_retailprice + CASE WHEN p_type ILIKE '%promo%' THEN max(p_retailprice) OVER (PARTITION BY p_brand) ELSE 0 END, 4) AS score FROM part""",
    "unmatched_dropped": """SELECT p_brand, p_partkey, p_type FROM part
QUALIFY p_type ILIKE '%promo%' OR max((p_type ILIKE '%promo%')::INT) OVER (PARTITION BY p_brand) = 0""",
    "ndcg_recall": f"""WITH {_DENSE}, total AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label),
got AS (SELECT query_id, query_label, sum(CASE WHEN label = query_label THEN 1.0::DOUBLE / log2(rank + 2) ELSE 0 END) AS dcg, sum((label = query_label)::INT) AS hits
  FROM dense WHERE rank < 10 GROUP BY query_id, query_label)
SELECT query_id, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg, round(hits::DOUBLE / n, 6) AS recall
FROM got JOIN total ON label = query_label WHERE n > 0""",
}
