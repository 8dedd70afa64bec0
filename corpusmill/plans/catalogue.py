"""Catalogue and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as C
from ..session import table

RULES = [(1, 1, 10, "small"), (2, 8, 25, "middle"), (3, 26, 50, "large")]


def document_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    wanted = C.all_of([C.in_locales(F.col("lang"), ["en", "de"], True), F.col("n_chars").between(200, 5000), F.col("quality") == 1, F.col("source").like("src1%")])
    return docs.where(wanted).select("doc_id", "lang", "source", "n_chars")


def glob_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(T.glob(F.col("p_name"), "*a?e*")).select("p_partkey", "p_name")


def problem_filter(spark: SparkSession, d: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    problem = C.any_of([status.isin("F"), priority.startswith("1"), (status == "O") & (F.col("o_totalprice") < 1000)])
    return table(spark, d, "orders").where(problem).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def locale_or_unknown(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("locale", F.when(F.col("lang") != "es", F.col("lang")))
    return docs.where(C.in_locales(F.col("locale"), ["fr"], True)).select("doc_id", "locale")


def locale_facets(spark: SparkSession, d: str) -> DataFrame:
    return C.facet(table(spark, d, "documents"), "lang").orderBy(F.col("n").desc(), "lang")


def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


def markup_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNotNull()).alias("marked"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def page_sorted(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    out = C.page(orders, [F.col("price").desc_nulls_last(), F.col("o_orderdate").desc(), F.col("o_orderkey")], 40, 20)
    return out.select("o_orderkey", "price", "total")


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return C.after(users, "conv_id", 60, 20).select("conv_id", "turn")


def user_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def tag_usage(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey")
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    links = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(open_orders, "l_orderkey")
    return C.usage(parts, "p_partkey", links)


def exists_filter(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(big, "o_orderkey", "left_semi")


def not_exists_filter(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(placed, "c_custkey", "left_anti")


def missing_translation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.where("quality IS NULL OR quality = 0").select("doc_id", F.when(F.col("quality").isNull(), "missing").otherwise("machine").alias("state"))


def correlated_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c",
        orders=table(spark, d, "orders"), customer=table(spark, d, "customer"),
    )


def range_rule_join(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id int, low int, high int, label string")
    return C.by_range(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", rules).select("p_partkey", "p_size", "rule_id", "label")


def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return C.reconcile(customers, orders, "id")


def ancestry_paths(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation, customer as one tree."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        table(spark, d, "region").select(tag("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .unionByName(table(spark, d, "nation").select(tag("n", "n_nationkey").alias("node"), tag("r", "n_regionkey").alias("parent")))
        .unionByName(table(spark, d, "customer").select(tag("c", "c_custkey").alias("node"), tag("n", "c_nationkey").alias("parent")))
    )
    return C.ancestry(edges).select("node", "root", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def set_delta(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("states")
    )
    return tags.select("l_orderkey", F.array_join(F.array_sort(T.tag_delta(F.col("flags"), F.array(F.lit("N")), F.col("states"))), ",").alias("tags"))


def hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Hits meet their canonical rows; hits of rows that are gone drop out."""
    hits = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return hits.join(table(spark, d, "documents"), "doc_id").select("doc_id", "source", F.substring("text", 1, 40).alias("head"))


def hydrate_whole(spark: SparkSession, d: str) -> DataFrame:
    """As hydrate, with the whole text."""
    hits = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return hits.join(table(spark, d, "documents"), "doc_id").select("doc_id", "source", "text")


def alias_conflicts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("alias"))
    return C.conflicts(words, "alias", "p_partkey")


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Types with their first letter at the end and without vowels find the type that is most alike."""
    types = table(spark, d, "part").select("p_type").distinct()
    turned = F.concat(F.substring("p_type", 2, 100), F.substring("p_type", 1, 1))
    return C.best_match(types.select(F.regexp_replace(turned, "[AEIOUaeiou]", "e").alias("typed")), types, "typed", "p_type", 0.6)


def tags_by_group(spark: SparkSession, d: str) -> DataFrame:
    out = C.tag_union(table(spark, d, "documents"), "source", "lang")
    return out.select("source", F.array_join("tags", ",").alias("tags"))


def next_version(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next"))
    return got.select("o_custkey", "next")


def contiguity(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    return got.withColumn("whole", (F.col("high") - F.col("low") + 1) == F.col("n"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", F.round(F.col("q")[0], 4).alias("p50"), F.round(F.col("q")[1], 4).alias("p95"))


def group_tags_top(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    rows = table(spark, d, "part").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return rows.select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT lang, source, count(*) AS n FROM {docs} GROUP BY GROUPING SETS ((lang), (source), ())", docs=table(spark, d, "documents")
    )


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return c.exceptAll(o.distinct()).unionByName(o.distinct().intersect(s)).distinct()


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    # each pair once before both counts: beside an exact count Spark holds a sketch for each pair
    pairs = table(spark, d, "lineitem").select("l_returnflag", "l_partkey").distinct()
    got = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.count("l_partkey").alias("n"))
    return got.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


def names_and_letters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.column_letters(F.col("p_partkey")).alias("letters"), T.column_number(T.column_letters(F.col("p_partkey"))).cast("long").alias("number"), T.slug("p_name", 20).alias("slug"))


def excel_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.excel_date(F.col("p_partkey") + 40000).cast("string").alias("day"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.lower("text").contains("token"))
    return docs.select("doc_id", T.snippet(F.col("text"), "token").alias("snippet"), F.md5(T.context_xml(F.col("doc_id"), F.col("text")).cast("binary")).alias("block"))


QUERIES = {
    f.__name__: f
    for f in (
        document_filter, glob_search, problem_filter, locale_or_unknown, locale_facets, distinct_sources, markup_progress, page_sorted, keyset_page,
        user_event_counts, tag_usage, exists_filter, not_exists_filter, missing_translation, correlated_count, range_rule_join, reconcile_full_outer,
        ancestry_paths, set_delta, hydrate, hydrate_whole, alias_conflicts, fuzzy_match, tags_by_group, next_version, contiguity, quantiles, group_tags_top,
        cube_rollup, grouping_sets, set_ops, approx_distinct, names_and_letters, excel_dates, snippets,
    )
}

ORACLES = {
    "document_filter": """SELECT doc_id, lang, source, n_chars FROM documents LEFT JOIN labels USING (doc_id)
WHERE (lang IN ('en', 'de') OR lang IS NULL) AND n_chars BETWEEN 200 AND 5000 AND quality = 1 AND source LIKE 'src1%'""",
    "glob_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a_e%'",
    "problem_filter": """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1%' OR (o_orderstatus = 'O' AND o_totalprice < 1000)""",
    "locale_or_unknown": "SELECT doc_id, CASE WHEN lang <> 'es' THEN lang END AS locale FROM documents WHERE lang IN ('fr', 'es')",
    "locale_facets": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "markup_progress": "SELECT count(*) AS total, count(quality) AS marked, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "page_sorted": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, (SELECT count(*) FROM orders) AS total
FROM orders ORDER BY price DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""",
    "keyset_page": "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' AND conv_id < 60 GROUP BY conv_id ORDER BY conv_id DESC LIMIT 21",
    "user_event_counts": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "tag_usage": """SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'O' GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "exists_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "not_exists_filter": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "missing_translation": """SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' ELSE 'machine' END AS state FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NULL OR quality = 0""",
    "correlated_count": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "range_rule_join": """SELECT p_partkey, p_size, rule_id, label FROM part JOIN (VALUES (1, 1, 10, 'small'), (2, 8, 25, 'middle'), (3, 26, 50, 'large')) r(rule_id, low, high, label)
ON p_size BETWEEN low AND high""",
    "reconcile_full_outer": """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'orphan' END AS state
FROM (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS id FROM orders) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""",
    "ancestry_paths": """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), w AS (SELECT node, node AS root, 0::BIGINT AS depth, node AS path FROM e WHERE parent IS NULL
UNION ALL SELECT e.node, w.root, w.depth + 1, w.path || '>' || e.node FROM e JOIN w ON e.parent = w.node) SELECT node, root, depth, path FROM w""",
    "set_delta": """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(list(DISTINCT l_returnflag), lambda x: x <> 'N'), list(DISTINCT l_linestatus)))), ',') AS tags
FROM lineitem GROUP BY l_orderkey""",
    "hydrate_whole": "SELECT doc_id, source, text FROM labels JOIN documents USING (doc_id) WHERE quality = 1",
    "hydrate": "SELECT doc_id, source, substr(text, 1, 40) AS head FROM labels JOIN documents USING (doc_id) WHERE quality = 1",
    "alias_conflicts": """SELECT alias, count(DISTINCT p_partkey) AS owners, min(p_partkey) AS first_owner FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS alias FROM part)
GROUP BY alias HAVING count(DISTINCT p_partkey) > 1""",
    "tags_by_group": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS tags FROM documents GROUP BY source",
    "next_version": "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM orders GROUP BY o_custkey",
    "contiguity": "SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high, max(turn) - min(turn) + 1 = count(*) AS whole FROM conversations GROUP BY conv_id",
    "quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag",
    "group_tags_top": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 3",
    "cube_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "set_ops": """(SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders) UNION (SELECT o_custkey FROM orders INTERSECT SELECT s_suppkey FROM supplier)""",
    "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS close FROM lineitem GROUP BY l_returnflag",
    "names_and_letters": r"""SELECT p_partkey, CASE WHEN p_partkey <= 26 THEN chr((64 + p_partkey)::INT)
WHEN p_partkey <= 702 THEN chr((64 + (p_partkey - 1) // 26)::INT) || chr((65 + (p_partkey - 1) % 26)::INT)
ELSE chr((64 + (p_partkey - 27) // 676)::INT) || chr((65 + (p_partkey - 27) // 26 % 26)::INT) || chr((65 + (p_partkey - 1) % 26)::INT) END AS letters, p_partkey AS number,
CASE WHEN length(s) <= 20 THEN s ELSE substr(regexp_replace(substr(s, 1, 21), '-[^-]*$', ''), 1, 20) END AS slug
FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)""",
    "excel_dates": "SELECT p_partkey, (DATE '1899-12-30' + (p_partkey + 40000)::INT)::DATE::VARCHAR AS day FROM part",
    "snippets": """SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'token') - 80), 240) AS snippet,
md5('<block id="' || doc_id || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</block>') AS block
FROM documents WHERE contains(lower(text), 'token')""",
}
