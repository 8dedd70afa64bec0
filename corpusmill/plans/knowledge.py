"""Tree, concept, evidence and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..operators import located, merges
from ..operators.answers import answers
from ..session import few, settled, table
from ..sources import sinks

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", K.uuid5(NAMESPACE, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.replace("p_type", F.lit(" "), F.lit("-")).alias("slug"))
    return K.unique_slugs(rows, "p_brand", "slug", "p_partkey")


def slug_families(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of which some carry the numbers that repeats of others would get."""
    end = "CASE p_size % 6 WHEN 0 THEN '-1' WHEN 1 THEN '-1-1' WHEN 2 THEN '-2' WHEN 3 THEN '-01' ELSE '' END"
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_brand", f"concat(substring_index(p_type, ' ', 1), {end}) AS slug")
    return K.unique_slugs(rows, "p_brand", "slug", "p_partkey")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), (F.col("n_nationkey") % 4 == 0).alias("flag"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") == 2).alias("flag"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit(False).alias("flag"))
    return regions.unionByName(nations).unionByName(customers)


def inherited_scope(spark: SparkSession, d: str) -> DataFrame:
    return K.inherited(_edges(spark, d), "node", "parent", "flag").select("node", F.col("depth").cast("long").alias("depth"), "inherited")


def tree_faults(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("node"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent"))
    return K.tree_faults(items, "l_orderkey", "node", "parent")


def proven_quotes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    facts = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 11, 30)).otherwise(F.concat(F.substring("text", 11, 10), F.lit("@@"))).alias("quote"))
    return K.evidence(facts, docs, "doc_id", "quote", "text").select("doc_id", "proven")


def trash_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted"))
    return K.retention(rows, "deleted", F.lit("2024-01-30").cast("date")).select("event_id", "days_left", "expired")


def batch_receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return K.receipts(rows, ["user_id", "day"], "event_id", "event_type").select("event_id", "receipt")


def outbox_due(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "view", "pending").otherwise("sent").alias("status"), K.backoff(F.col("event_id") % 9).alias("wait"))
    return K.due(rows, "status", "ts", F.lit("2024-01-15").cast("timestamp_ntz"), ["event_id"], 50).select("event_id", "wait")


def token_runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose halves share a run of eight tokens."""
    t, n = F.col("text"), F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = table(spark, d, "documents").select("doc_id", K.longest_run(F.substring(t, 1, half), F.substring(t, half + 1, n)).alias("shares"))
    return rows.where("shares").select("doc_id")


def cited(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("see block with ID "), F.col("p_size").cast("string"), F.lit(" and source ["), F.col("p_size").cast("string"), F.lit("] [99] [99]"))
    return table(spark, d, "part").select("p_partkey", K.citations(said).alias("text"))


def verified_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a chunk, with hits on all its fragments; the first of German fragments points elsewhere, French documents changed since."""
    docs = _one_each(table(spark, d, "documents").select("doc_id", "text", "lang"))
    index, contents = located.indexed(docs, ["doc_id"], "text", 900)
    german = docs.where("lang = 'de'").select("doc_id", F.lit(True).alias("bad"))
    index = settled(index.join(german, "doc_id", "left").withColumn("hash", F.when(F.col("bad") & (F.col("ordinal") == 0), F.reverse("hash")).otherwise(F.col("hash"))).drop("bad"))
    now = docs.select("doc_id", F.when(F.col("lang") == "fr", F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text"))
    shown = located.hydrated(index.select("doc_id", "ordinal"), index, contents, now, ["doc_id"], "text")
    # a fragment's text is kept, of a whole chunk, which each of its hits shows, the digest
    kept = F.when(F.col("basis") == "fragment", F.struct("ordinal", "shown"))
    rows = shown.select("doc_id", "basis", kept.alias("kept"), F.when(F.col("basis") != "fragment", F.md5(F.col("shown").cast("binary"))).alias("other"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("kept")), lambda x: x["shown"]), "")
    return rows.groupBy("doc_id", "basis").agg(F.coalesce(F.max("other"), F.when(F.col("basis") == "fragment", F.md5(whole.cast("binary")))).alias("digest"))


def _one_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang): the greatest text and language of each id. Only rows whose id occurs again are brought together."""
    again = few(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    merged = docs.join(again, same, "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("lang").alias("lang"))
    return docs.join(again, same, "left_anti").unionByName(merged)


def conditional_purge(spark: SparkSession, d: str) -> DataFrame:
    """Errors were listed for purging; those of some users were restored meanwhile."""
    rows = table(spark, d, "events").select("event_id", F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 > 0), F.col("ts")).alias("deleted"))
    listed = table(spark, d, "events").where("event_type = 'error' AND value > 10").select("event_id")
    return sinks.purged(rows, listed, "event_id", "deleted").select("event_id")


def cloned_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.lit("g1").alias("generation"))
    chosen = table(spark, d, "documents").where("lang = 'es'").select("source")
    return sinks.cloned(rows, "g1", "g2", "source", chosen)


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a term that merges into the next one; the kind is chosen, small parts leave their description open."""
    term = "named_struct('original_name', p_name, 'original_description', CASE WHEN p_size > 9 THEN p_type END, 'canonical_locale', 'en', 'kind', p_brand, 'infotype_number', cast(null AS string), 'enabled', p_size % 2 = 0, 'source_revision', 1L, 'version', p_partkey, 'aliases', array(named_struct('alias', upper(p_brand), 'locale', 'en', 'auto_expand', p_size % 2 = 0, 'search_enabled', true)))"
    parts = table(spark, d, "part").selectExpr("p_partkey", f"{term} AS s")
    pairs = parts.join(parts.selectExpr("p_partkey - 1 AS p_partkey", "s AS t"), "p_partkey").selectExpr("*", "map('kind', 'source') AS c", "cast(map() AS map<string,struct<locale:string,auto_expand:boolean,search_enabled:boolean>>) AS a")
    got = merges.merged(pairs, "s", "t", "c", "a")
    return got.select(
        "p_partkey", "merged.original_name", "merged.original_description", "merged.kind", "merged.source_revision", "merged.version",
        F.array_join(F.transform("merged.aliases", lambda x: x["alias"]), "|").alias("aliases"), F.array_join("unresolved", "|").alias("unresolved"),
    )


def recovered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Lists of an event's properties that break off in the third."""
    cut = F.expr("concat('Answer: [', props, ', ', props, ', ', substring(props, 1, event_id % length(props)))")
    return answers(table(spark, d, "events").select("event_id", cut.alias("said")), "event_id", "said")


QUERIES = {
    f.__name__: f
    for f in (point_ids, unique_slugs, slug_families, inherited_scope, tree_faults, proven_quotes, trash_retention, batch_receipts, outbox_due, token_runs, cited, verified_fragments, conditional_purge, cloned_sources, recovered_answers, merged_terms)
}

_RUN = """list_transform(range(1, len({t}) - 6), lambda i: array_to_string({t}[i:i + 7], ' '))"""
_TOK = "regexp_extract_all(replace(lower({s}), chr(775), ''), '[a-zа-яё0-9ßà-öø-ÿā-žșț]+')"
ORACLES = {
    "point_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('doc:' || doc_id)::BLOB) AS x FROM documents)
SELECT doc_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || printf('%02x', (('0x' || x[17:18])::INT & 63) | 128) || x[19:20] || '-' || x[21:32] AS point_id FROM h""",
    "unique_slugs": """SELECT p_partkey, p_brand, CASE WHEN n > 1 THEN s || '-' || (n - 1) ELSE s END AS slug FROM (SELECT p_partkey, p_brand, replace(p_type, ' ', '-') AS s,
row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)""",
    "slug_families": """
WITH RECURSIVE b AS (SELECT p_partkey, p_brand, split_part(p_type, ' ', 1) AS f, split_part(p_type, ' ', 1) || CASE p_size % 6 WHEN 0 THEN '-1' WHEN 1 THEN '-1-1' WHEN 2 THEN '-2' WHEN 3 THEN '-01' ELSE '' END AS s FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, f ORDER BY p_partkey) AS i FROM b),
w AS (SELECT p_partkey, p_brand, f, i, s AS slug, [s] AS used FROM r WHERE i = 1
  UNION ALL SELECT p_partkey, p_brand, f, i, slug, list_append(used, slug) FROM (SELECT r.*, w.used,
    list_filter(list_concat([r.s], list_transform(range(1, len(w.used) + 2), lambda k: r.s || '-' || k)), lambda n: NOT list_contains(w.used, n))[1] AS slug
    FROM w JOIN r ON r.p_brand = w.p_brand AND r.f = w.f AND r.i = w.i + 1))
SELECT p_partkey, p_brand, slug FROM w""",
    "inherited_scope": """SELECT 'r' || r_regionkey AS node, 0::BIGINT AS depth, r_regionkey = 2 AS inherited FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, n_nationkey % 4 = 0 OR n_regionkey = 2 FROM nation
UNION ALL SELECT 'c' || c_custkey, 2, c_nationkey % 4 = 0 OR n_regionkey = 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "tree_faults": """SELECT l_orderkey, count(*) AS nodes, count(*) - count(DISTINCT l_linenumber) AS repeated, count(*) FILTER (l_linenumber <= 1) AS roots,
count(*) FILTER (l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1)) AS strays
FROM lineitem l GROUP BY l_orderkey""",
    "proven_quotes": r"""WITH q AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t,
trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 30) ELSE substr(text, 11, 10) || '@@' END, '\s+', ' ', 'g')) AS q FROM documents)
SELECT doc_id, q <> '' AND contains(t, q) AS proven FROM q""",
    "trash_retention": """SELECT event_id, CASE WHEN event_type = 'error' THEN greatest(14 - date_diff('day', ts::DATE, DATE '2024-01-30'), 0) END::INT AS days_left,
coalesce(event_type = 'error' AND 14 - date_diff('day', ts::DATE, DATE '2024-01-30') <= 0, false) AS expired FROM events""",
    "batch_receipts": """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN first_value(event_type) OVER w = event_type THEN 'duplicate' ELSE 'conflict' END AS receipt
FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY event_id)""",
    "outbox_due": """SELECT event_id, least(60, 2 ** (event_id % 9))::BIGINT AS wait FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 50""",
    "token_runs": f"""WITH t AS (SELECT doc_id, {_TOK.format(s="substr(text, 1, length(text) // 2)")} AS a,
{_TOK.format(s="substr(text, length(text) // 2 + 1)")} AS b FROM documents)
SELECT doc_id FROM t WHERE len(a) >= 8 AND len(b) >= 8 AND list_has_any({_RUN.format(t='a')}, {_RUN.format(t='b')})""",
    "verified_fragments": """WITH d AS (SELECT doc_id, coalesce(max(text), '') AS text, max(lang) AS lang FROM documents GROUP BY doc_id),
h AS (SELECT *, lang NOT IN ('de', 'fr') AS sound FROM d)
SELECT doc_id, CASE WHEN sound THEN 'fragment' ELSE 'chunk' END AS basis, md5(CASE WHEN lang = 'fr' THEN 'new ' ELSE '' END || text) AS digest FROM h""",
    "recovered_answers": r"""SELECT event_id, 'recovered' AS status, '[' || p || ',' || p || ']' AS value FROM (SELECT event_id, regexp_replace(props, '\s', '', 'g') AS p FROM events)""",
    "merged_terms": """WITH p AS (SELECT p_partkey AS k, p_name AS n, CASE WHEN p_size > 9 THEN p_type END AS d, p_brand AS b, p_size % 2 = 0 AS e, lower(p_brand) AS f FROM part)
SELECT s.k AS p_partkey, t.n AS original_name, coalesce(t.d, s.d) AS original_description, s.b AS kind, (1 + (t.d IS NULL AND s.d IS NOT NULL)::INT)::BIGINT AS source_revision, t.k + 1 AS version,
upper(t.b) || CASE WHEN s.f <> t.f THEN '|' || upper(s.b) ELSE '' END || CASE WHEN lower(s.n) <> lower(t.n) THEN '|' || s.n ELSE '' END AS aliases,
concat_ws('|', CASE WHEN s.n <> t.n THEN 'original_name' END, CASE WHEN s.d <> t.d THEN 'original_description' END, CASE WHEN s.e <> t.e THEN 'enabled' END,
CASE WHEN s.f = t.f AND s.e <> t.e THEN 'aliases[' || t.f || ']' END) AS unresolved FROM p s JOIN p t ON t.k = s.k + 1""",
    "conditional_purge": "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND user_id % 3 > 0 AND value > 10)",
    "cloned_sources": """SELECT doc_id, source, 'g1' AS generation FROM documents
UNION ALL SELECT doc_id, source, 'g2' FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es')""",
    "cited": "SELECT p_partkey, 'see [' || p_size || '] and [' || p_size || '] [99]' AS text FROM part",
}
