"""Queries of scopes, visibility, listings and evidence, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import scopes as S
from ..operators.areas import subtracted
from ..session import table

_SCOPE = "CASE WHEN {0} % 3 = 0 THEN 'mail' WHEN {0} % 3 = 1 THEN 'document' WHEN {0} % 5 = 2 THEN 'unknown' END"


def scope_prefilter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumns({"tags": F.array("source", "lang"), "scope": F.expr(_SCOPE.format("doc_id")), "gone": F.expr("nullif(doc_id % 7, 1) = 0")})
    wanted = S.prefilter(tags=([F.col("tags")], ["src1", "src12", "en"]), locale=F.col("lang"), locales=("en", "de"), mail=(F.col("scope"), "exclude"), deleted=F.col("gone"))
    return docs.where(wanted).select("doc_id", "lang", "scope")


def _generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as points of customers, customers' generations, removed generations."""
    points = table(spark, d, "orders").selectExpr("o_orderkey AS point_id", "o_custkey AS doc_id", "CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 10 + o_orderkey % 3 END AS generation_id")
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    generations = rows.selectExpr("c_custkey AS doc_id", "c_custkey * 10 + k AS generation_id", "CASE WHEN k = 1 THEN 'staged' ELSE 'active' END AS phase", "c_custkey % 5 = 0 AND k = 0 AS cleanup_pending")
    return points, generations, generations.where("doc_id % 11 = 3 AND phase = 'active'").select("generation_id")


def shown_points(spark: SparkSession, d: str) -> DataFrame:
    return S.shown(*_generations(spark, d)).select("point_id", "doc_id", "generation_id")


def current_hits(spark: SparkSession, d: str) -> DataFrame:
    points, generations, _ = _generations(spark, d)
    docs = table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "c_acctbal < 0 AS deleted")
    state = generations.where("generation_id % 10 = 2 AND doc_id % 4 > 0").selectExpr("doc_id", "generation_id AS active_generation_id")
    return S.current(points, docs, state)


def proven_blocks(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber AS n", "l_orderkey % 50 AS source_id", "l_quantity > 2 AS verified", "CASE WHEN l_tax > 0.01 THEN 'document' ELSE 'mail' END AS scope")
    blocks = parts.groupBy("l_orderkey").agg(F.collect_list(F.struct("source_id", "verified", "scope")).alias("components"))
    rows = table(spark, d, "orders").join(blocks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.withColumns({"verified": F.col("o_orderstatus") != "F", "scope": F.lit("document"), "source_id": F.col("o_orderkey") % 50})
    ok = S.proven({c: F.col(c) for c in ("verified", "scope", "source_id")}, F.col("components"), ["source_id"], "exclude")
    return rows.where(ok).select("o_orderkey", F.size("components").alias("n"))


def published_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "c_acctbal < 0 AS deleted", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'done' ELSE 'failed' END AS status")
    orders = table(spark, d, "orders").selectExpr("o_custkey AS doc_id", "o_orderstatus", "o_orderpriority")
    state = orders.selectExpr("doc_id", "CASE WHEN o_orderpriority LIKE '1%' THEN 1 END AS active_generation_id")
    return S.published(docs, state, orders.where("o_orderstatus = 'P'"))


def versions_listed(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS owner_id", "CASE WHEN c_acctbal > 5000 THEN 'public' ELSE 'private' END AS visibility", "c_custkey % 3 AS current_version")
    versions = table(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey % 3 AS version", "o_orderpriority AS name", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS description")
    return S.versions_seen(heads, versions.distinct(), 7, "all", " High ").select("id", "current_version", "name", "description")


def multi_field_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    sold = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    links = [(sold.where("l_quantity = 50").withColumn("flag", F.concat("l_returnflag", F.lit("ar"), "l_linestatus")), "p_partkey", ["flag"])]
    links = [(rows.withColumnRenamed("l_partkey", "p_partkey"), key, fields) for rows, key, fields in links]
    return S.searched(parts, "AR", "p_name", ["p_brand", "p_type"], links).select("p_partkey", "p_name")


def trash_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").withColumn("deleted", F.when(F.col("o_orderkey") % 3 == 0, F.date_trunc("month", "o_orderdate")))
    order = S.listing("price_asc", {"price": "price", "date": "o_orderdate"}, "o_orderdate", trash="deleted")
    rows = docs.withColumn("price", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice"))).where("deleted IS NOT NULL")
    return rows.orderBy(*order, "o_orderkey").limit(25).select("o_orderkey", "price")


def development_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_brand AS number", "p_name AS name", "CASE WHEN p_size > 20 THEN p_type END AS module", "p_partkey")
    return S.developments(rows, "Brand#1", "__none__").select("p_partkey", "number")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    since, until = (S.day_bound(F.lit(x), end) for x, end in ((" 2024-01-05 ", False), ("2024-01-09", True)))
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return S.logged(rows, "at", since, until, event_type="click", user_id=None).select("event_id", "user_id")


def day_bounds(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN cast(cast(ts AS date) AS string) WHEN 1 THEN '2024-13-01' WHEN 2 THEN 'soon' END")
    rows = table(spark, d, "events").withColumn("t", text)
    return rows.select("event_id", F.unix_micros(S.day_bound(F.col("t"), False)).alias("low"), F.unix_micros(S.day_bound(F.col("t"), True)).alias("high"))


def resolved_tags(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    tags = parts.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("canonical_text")).agg(F.min("p_partkey").alias("tag_id"))
    translations = parts.selectExpr("p_partkey AS tag_id", "p_type AS text", "CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'fr' END AS locale").where("tag_id % 3 = 0")
    return S.resolved_tags(parts.selectExpr("p_type AS text", "CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'es' END AS locale"), tags, translations)


def displayed_names(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    terms = parts.selectExpr("p_partkey AS term_id", "p_name AS original_name", "CASE WHEN p_size < 5 THEN 'de' ELSE 'en' END AS canonical_locale", "p_size % 4 AS source_revision")
    translations = parts.where("p_partkey % 2 = 0").selectExpr("p_partkey AS term_id", "upper(p_name) AS display_name", "'de' AS locale", "p_partkey % 4 AS source_revision")
    return S.displayed(terms, translations, "de")


def active_stop_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").selectExpr("explode(split(text, ' ')) AS word", "lang AS locale")
    locales = spark.createDataFrame([("de", True), ("fr", False), ("es", True)], "locale string, is_active boolean")
    return S.stop_words(words, locales)


def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").selectExpr("l_suppkey % 5 AS sheet", "l_orderkey % 40 AS row", "l_linenumber AS col", "l_orderkey", "l_linenumber")
    merges = table(spark, d, "part").selectExpr("p_partkey % 5 AS sheet", "p_size % 30 AS top", "p_size % 30 + 2 AS bottom", "p_partkey % 6 AS left", "p_partkey % 6 + 1 AS right", "p_partkey AS merge_id")
    return S.merged(cells, merges).select("l_orderkey", "l_linenumber", "merge_id")


def recommended_scope(spark: SparkSession, d: str) -> DataFrame:
    """Regions as inventories: nations under none, customers under their nation, customers under other customers by number."""
    nations = table(spark, d, "nation").selectExpr("n_regionkey AS region", "concat('n', n_nationkey) AS node", "cast(null AS string) AS parent", "CASE WHEN n_nationkey % 7 = 3 THEN 'unsupported' END AS why", "cast(0 AS bigint) AS rows", "cast(10 AS bigint) AS cells")
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("n_nationkey = c_nationkey"))
    customers = joined.selectExpr(
        "n_regionkey AS region", "concat('c', c_custkey) AS node", "concat('n', c_nationkey) AS parent", "CASE WHEN c_custkey % 13 = 5 THEN 'unknown' END AS why",
        "cast(abs(c_acctbal) AS bigint) AS rows", "c_custkey % 40 AS cells",
    )
    orders = table(spark, d, "orders").join(joined, F.expr("o_custkey = c_custkey")).groupBy("n_regionkey", "o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").cast("long").alias("most"))
    under = orders.selectExpr("n_regionkey AS region", "concat('o', o_custkey) AS node", "concat('c', o_custkey) AS parent", "cast(null AS string) AS why", "most % 5000 AS rows", "n AS cells")
    nodes = nations.unionByName(customers).unionByName(under)
    return S.recommended(nodes, ["region"], "node", "parent", "why", {"rows": 90_000, "cells": 900})


def subtracted_areas(spark: SparkSession, d: str) -> DataFrame:
    """The cells that are left of small areas."""
    parts = table(spark, d, "part")
    areas = parts.selectExpr("p_partkey AS area", "p_partkey % 50 AS sheet", "p_size AS top", "p_partkey % 9 AS left", "p_size + p_partkey % 6 AS bottom", "p_partkey % 9 + p_partkey % 5 AS right")
    cuts = parts.selectExpr("p_partkey % 50 AS sheet", "p_size + 1 AS top", "p_partkey % 7 + 1 AS left", "p_size + p_partkey % 4 AS bottom", "p_partkey % 7 + p_partkey % 3 AS right")
    left = subtracted(areas, cuts, "area", "sheet")
    return left.select("area", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right").select("area", "row", F.explode(F.sequence("left", "right")).alias("col"))


def depth_first_order(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.array(F.struct(F.col("n_regionkey").cast("long").alias("o"), F.lit("").alias("k")), F.struct((F.col("n_nationkey") % 3).cast("long").alias("o"), F.col("n_name").alias("k"))).alias("path"))
    chunks = table(spark, d, "customer").selectExpr("c_mktsegment AS doc_id", "c_nationkey AS source_id", "c_custkey AS chunk_index", "CASE WHEN c_custkey % 2 = 0 THEN -c_custkey END AS local_order")
    return S.display_order(nations, chunks).select("chunk_index", "display_order")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS score", "o_orderstatus AS s")
    return S.first_seen([orders.where("s = 'P'"), orders.where("s = 'F' AND id % 2 = 0"), orders.drop("s")], "id", "score", 60)


def complete_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = ["the", "est", "und der", "no."]
    docs = table(spark, d, "documents")
    return docs.select("doc_id", E.holds_form(F.col("text"), forms).alias("phrase"), E.holds_form(F.col("text"), ["ing", "on"], "identifier").alias("code"), E.has_negation(F.col("text")).alias("negated"))


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    span = E.line_span(F.col("text"), 1, 3)
    return table(spark, d, "documents").select("doc_id", span["start"].alias("start"), span["end"].alias("end"))


def unique_quotes(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    quote = F.array_join(F.slice(words, F.lit(2), F.greatest(F.lit(1), F.pmod("doc_id", F.lit(6)).cast("int"))), "  ")
    span = E.unique_quote(F.col("text"), quote)
    return table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id").select("doc_id", span["start"].alias("start"), span["end"].alias("end"))


def best_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    asked = turns.where("turn = 0").selectExpr("conv_id", "text AS content", "role AS title")
    return E.best_paragraphs(turns.where("turn > 0").join(asked, "conv_id"), "conv_id", "turn", "text", "title", "content")


_QUERIES = (
    scope_prefilter, shown_points, current_hits, proven_blocks, published_ids, versions_listed, multi_field_search, trash_listing, development_search, event_log,
    day_bounds, resolved_tags, displayed_names, active_stop_words, merged_cells, recommended_scope, subtracted_areas, depth_first_order, first_seen, complete_forms, line_spans, unique_quotes, best_paragraphs,
)
QUERIES = {f.__name__: f for f in _QUERIES}
ORACLES = {
    "scope_prefilter": f"""
SELECT doc_id, lang, {_SCOPE.format("doc_id")} AS scope FROM documents
WHERE (source IN ('src1', 'src12') OR lang = 'en') AND lang IN ('en', 'de') AND doc_id % 3 = 1 AND coalesce(nullif(doc_id % 7, 1) <> 0, true)""",
    "shown_points": """
WITH g AS (SELECT c_custkey AS doc_id, c_custkey * 10 + k AS generation_id, k = 1 OR c_custkey % 11 = 3 AS hidden, c_custkey % 5 = 0 AS waits FROM customer, (SELECT unnest([0, 1, 2]) AS k)),
p AS (SELECT o_orderkey AS point_id, o_custkey AS doc_id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 10 + o_orderkey % 3 END AS generation_id FROM orders)
SELECT * FROM p WHERE coalesce(generation_id NOT IN (SELECT generation_id FROM g WHERE hidden), true)
AND NOT (generation_id IS NULL AND doc_id IN (SELECT doc_id FROM g WHERE waits))""",
    "current_hits": """
SELECT o_orderkey AS point_id, o_custkey AS doc_id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 10 + o_orderkey % 3 END AS generation_id
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0
AND CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 10 + o_orderkey % 3 END IS NOT DISTINCT FROM CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 10 + 2 END""",
    "proven_blocks": """
SELECT o_orderkey, count(*)::INT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'F' GROUP BY o_orderkey HAVING bool_and(l_quantity > 2 AND l_tax > 0.01)""",
    "published_ids": """
SELECT c_custkey AS doc_id FROM customer WHERE c_acctbal >= 0 AND (c_mktsegment = 'BUILDING'
OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR o_orderpriority LIKE '1%')))""",
    "versions_listed": """
SELECT DISTINCT c_custkey AS id, c_custkey % 3 AS current_version, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS description
FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = c_custkey % 3
WHERE (c_nationkey = 7 OR c_acctbal > 5000) AND o_orderpriority ILIKE '%high%'""",
    "multi_field_search": """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ar%' OR p_brand ILIKE '%ar%' OR p_type ILIKE '%ar%'
OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)""",
    "trash_listing": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 3 = 0
ORDER BY date_trunc('month', o_orderdate) DESC, price ASC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 25""",
    "development_search": """
SELECT p_partkey, p_brand AS number FROM part WHERE (p_brand LIKE 'Brand#1%' OR p_name ILIKE '%brand#1%') AND (p_size <= 20 OR p_type IS NULL)""",
    "event_log": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-10'",
    "day_bounds": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN epoch_us(date_trunc('day', ts)) END::BIGINT AS low,
CASE WHEN event_id % 4 = 0 THEN epoch_us(date_trunc('day', ts)) + 86400000000 - 1 END::BIGINT AS high FROM events""",
    "resolved_tags": """
WITH a AS (SELECT DISTINCT p_type AS text, CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'es' END AS locale FROM part)
SELECT text, locale, coalesce(
  (SELECT min(p_partkey) FROM part WHERE p_partkey % 3 = 0 AND p_type = text AND CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'fr' END = locale),
  (SELECT min(p_partkey) FROM part WHERE p_partkey % 2 = 0 AND p_type = text)) AS tag_id FROM a""",
    "displayed_names": """
SELECT p_partkey AS term_id, CASE WHEN t THEN upper(p_name) ELSE p_name END AS name, CASE WHEN t OR p_size < 5 THEN 'de' ELSE 'en' END AS locale, p_size >= 5 AND NOT t AS is_fallback
FROM (SELECT *, p_size >= 5 AND p_partkey % 2 = 0 AND p_partkey % 4 = p_size % 4 AS t FROM part)""",
    "active_stop_words": "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents WHERE lang IN ('de', 'es')",
    "merged_cells": """
SELECT l_orderkey, l_linenumber, p_partkey AS merge_id FROM lineitem JOIN part ON p_partkey % 5 = l_suppkey % 5
AND l_orderkey % 40 BETWEEN p_size % 30 AND p_size % 30 + 2 AND l_linenumber BETWEEN p_partkey % 6 AND p_partkey % 6 + 1""",
    "recommended_scope": """
WITH RECURSIVE nodes AS (
  SELECT n_regionkey AS region, 'n' || n_nationkey AS node, NULL AS parent, CASE WHEN n_nationkey % 7 = 3 THEN 'unsupported' END AS why, 0::BIGINT AS rows, 10::BIGINT AS cells FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 13 = 5 THEN 'unknown' END, trunc(abs(c_acctbal))::BIGINT, c_custkey % 40 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT n_regionkey, 'o' || o_custkey, 'c' || o_custkey, NULL, trunc(max(o_totalprice))::BIGINT % 5000, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey, o_custkey
), walk AS (
  SELECT region, node, why IS NULL AS open FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.region, n.node, w.open AND n.why IS NULL FROM nodes n JOIN walk w ON n.region = w.region AND n.parent = w.node
), ranked AS (
  SELECT n.*, row_number() OVER (PARTITION BY region ORDER BY greatest(rows / 90000, cells / 900) DESC, node) AS turn FROM nodes n JOIN walk USING (region, node) WHERE open
), turns AS (
  SELECT region, node, turn AS goes FROM ranked WHERE parent IS NULL
  UNION ALL SELECT r.region, r.node, least(r.turn, t.goes) FROM ranked r JOIN turns t ON r.region = t.region AND r.parent = t.node
), each AS (SELECT region, goes, sum(rows) AS rows, sum(cells) AS cells FROM ranked JOIN turns USING (region, node) GROUP BY region, goes),
steps AS (SELECT region, 0 AS k FROM each UNION SELECT region, goes FROM each),
done AS (
  SELECT region, min(k) AS k FROM steps s WHERE coalesce((SELECT sum(rows) FROM each e WHERE e.region = s.region AND e.goes > s.k), 0) < 90000
  AND coalesce((SELECT sum(cells) FROM each e WHERE e.region = s.region AND e.goes > s.k), 0) < 900 GROUP BY region
)
SELECT n.region, n.node, coalesce(t.goes > d.k, false) AS included,
CASE WHEN n.why IS NOT NULL THEN n.why WHEN t.goes > d.k THEN 'small' WHEN t.goes = r.turn THEN 'aggregate_budget' ELSE 'ancestor_excluded' END AS reason
FROM nodes n LEFT JOIN turns t USING (region, node) LEFT JOIN ranked r USING (region, node) LEFT JOIN done d ON d.region = n.region""",
    "subtracted_areas": """
WITH a AS (SELECT p_partkey AS area, p_partkey % 50 AS sheet, p_size AS t, p_partkey % 9 AS l, p_size + p_partkey % 6 AS b, p_partkey % 9 + p_partkey % 5 AS r FROM part),
c AS (SELECT p_partkey % 50 AS sheet, p_size + 1 AS t, p_partkey % 7 + 1 AS l, p_size + p_partkey % 4 AS b, p_partkey % 7 + p_partkey % 3 AS r FROM part),
x AS (SELECT area, sheet, row, unnest(range(l, r + 1)) AS col FROM (SELECT *, unnest(range(t, b + 1)) AS row FROM a))
SELECT area, row, col FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sheet = x.sheet AND row BETWEEN c.t AND c.b AND col BETWEEN c.l AND c.r)""",
    "depth_first_order": """
SELECT c_custkey AS chunk_index, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_regionkey, n_nationkey % 3, n_name,
CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey END) - 1)::INT AS display_order FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "first_seen": """
WITH l AS (
  (SELECT 0 AS l, o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'P')
  UNION ALL (SELECT 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)
  UNION ALL (SELECT 2, o_orderkey, o_totalprice FROM orders)
), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l) AS k FROM l)
SELECT id, (row_number() OVER (ORDER BY l, score DESC, id) - 1)::INT AS place, score FROM f WHERE k = 1 ORDER BY l, score DESC, id LIMIT 60""",
    "complete_forms": r"""
SELECT doc_id, regexp_matches(t, '(^|[^\p{L}\p{N}_])(the|est|und der|no\.)($|[^\p{L}\p{N}_])') OR regexp_matches(t, '(^|[^\p{L}\p{N}_])no\.') AS phrase,
regexp_matches(t, '(^|[^\p{L}\p{N}_/.:-]|(^|[^\p{L}\p{N}_/.:-])[.:-]+)(ing|on)([.:-]*)($|[^\p{L}\p{N}_/.:-])') AS code,
regexp_matches(t, '(^|[^\p{L}\p{N}_])(не|нет|без|not|no)($|[^\p{L}\p{N}_])') AS negated
FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents)""",
    "line_spans": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents), n AS (
  SELECT doc_id, text, p, len(p) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM l)
SELECT doc_id, CASE WHEN lines >= 3 THEN length(p[1]) + 1 END::INT AS start,
CASE WHEN lines >= 3 THEN least(length(text), length(p[1]) + length(p[2]) + length(p[3]) + 3) END::INT AS "end" FROM n""",
    "unique_quotes": r"""
WITH w AS (SELECT item_id AS doc_id, replace(text, chr(10), ' ') AS text, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT doc_id, text, array_to_string(w[2:1 + greatest(1, doc_id % 6)], ' ') AS q FROM w)
SELECT doc_id, CASE WHEN ok THEN instr(text, q) - 1 END::INT AS start, CASE WHEN ok THEN instr(text, q) - 1 + length(q) END::INT AS "end"
FROM (SELECT *, q <> '' AND instr(text, q) > 0 AND instr(substr(text, instr(text, q) + 1), q) = 0 AS ok FROM q)""",
    "best_paragraphs": rf"""
WITH stop AS (SELECT {[*E.EVIDENCE_STOP_WORDS]} AS s), t AS (
  SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: (length(x) >= 4 OR regexp_matches(x, '[0-9]')) AND NOT list_contains(s, x))) AS w, role
  FROM conversations, stop
), a AS (SELECT conv_id, w AS asked, CASE WHEN list_contains((SELECT s FROM stop), role) OR length(role) < 4 THEN []::VARCHAR[] ELSE [role] END AS title FROM t WHERE turn = 0),
s AS (SELECT t.conv_id, turn, CASE WHEN len(list_intersect(w, asked)) < 2 AND NOT len(list_filter(list_intersect(w, asked), lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 0
  ELSE 2 * len(list_intersect(w, asked)) + len(list_intersect(w, title)) END::INT AS score FROM t JOIN a ON t.conv_id = a.conv_id WHERE turn > 0),
r AS (SELECT *, max(score) OVER (PARTITION BY conv_id) AS best, count(*) OVER (PARTITION BY conv_id) AS n, count(*) OVER (PARTITION BY conv_id, score) AS ties FROM s)
SELECT conv_id, turn, score FROM r WHERE score = best AND score > 0 AND ties = 1 AND n > 1""",
}
