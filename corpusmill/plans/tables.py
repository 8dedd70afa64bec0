"""Queries of tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asked as A
from ..operators import tables as T
from ..operators.regions import stacked
from ..session import table

_HEADER = ["No", "Field name", "Data type", "Length", "Cardinality", "Description"]


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of field tables, one table for each brand."""
    name = F.regexp_replace("p_name", " ", "_")
    cells = F.array(F.col("p_partkey").cast("string"), name, "p_type", F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, "1").otherwise(""), F.concat(F.lit("about "), "p_name"))
    return table(spark, d, "part").select("p_partkey", "p_brand", cells.alias("cells"), F.array(*map(F.lit, _HEADER)).alias("header"))


def field_records(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("p_partkey", T.field_record(F.col("header"), F.col("cells")).alias("r")).select("p_partkey", "r.*")


def table_fragments(spark: SparkSession, d: str) -> DataFrame:
    return T.row_fragments(_fields(spark, d), ["p_partkey"], "header", "cells", 40).select("p_partkey", "part", "fragment", "first", "last")


def table_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('part ', l_partkey, ' from ', l_suppkey) AS fragment")
    return T.projected(rows, "l_orderkey", ["l_linenumber"], 60)


def table_previews(spark: SparkSession, d: str) -> DataFrame:
    rows = _fields(spark, d).withColumns({"header": F.concat("header", "header", "header"), "cells": F.concat("cells", "cells", "cells")})
    shown = T.previews(rows, "p_brand", "p_partkey", "header", "cells")
    return shown.select("p_brand", F.array_join("columns", "|").alias("columns"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("shown"))


def header_paths(spark: SparkSession, d: str) -> DataFrame:
    """Seven customers as a sheet: a merged title over all, a group over each two, a name under it."""
    lines = table(spark, d, "customer").selectExpr("c_custkey div 7 AS sheet", "cast(c_custkey % 7 AS int) + 1 AS col", "c_name")
    heads = [lines.where("col = 1").selectExpr("sheet", "1 AS row", "1 AS col", "'order' AS value"), lines.where("col % 2 = 1").selectExpr("sheet", "2 AS row", "col", "concat('group ', col) AS value")]
    cells = heads[0].unionByName(heads[1]).unionByName(lines.selectExpr("sheet", "3 AS row", "col", "CASE WHEN col = 3 THEN 'group 3' ELSE c_name END AS value"))
    merges = lines.groupBy("sheet").agg(F.max("col").alias("right")).selectExpr("sheet", "1 AS top", "1 AS bottom", "1 AS left", "right")
    merges = merges.unionByName(lines.where("col % 2 = 1").selectExpr("sheet", "2 AS top", "2 AS bottom", "col AS left", "col + 1 AS right"))
    out = T.header_paths(cells, merges).join(lines.select("sheet", "col"), ["sheet", "col"])
    return out.select("sheet", "col", F.array_join("path", " / ").alias("path"))


def stacked_tables(spark: SparkSession, d: str) -> DataFrame:
    """Forty parts to a sheet, a name and a type or a size in each row; rows of some sizes are missing, so tables begin behind gaps."""
    parts = table(spark, d, "part").selectExpr("cast(p_partkey div 40 AS int) AS sheet", "cast(p_partkey % 40 AS int) + 1 AS row", "*").where("p_size % 5 <> 0")
    cells = parts.selectExpr("sheet", "row", "1 AS col", "p_name AS text", "'string' AS kind", "false AS formula", "p_size % 2 = 0 AS bold")
    cells = cells.unionByName(parts.selectExpr("sheet", "row", "2 AS col", "CASE WHEN p_size % 3 = 0 THEN p_type ELSE cast(p_size AS string) END AS text", "CASE WHEN p_size % 3 = 0 THEN 'string' ELSE 'number' END AS kind", "false AS formula", "p_size % 2 = 0 AS bold"))
    areas = parts.select("sheet").distinct().selectExpr("sheet AS area", "sheet", "1 AS top", "1 AS left", "40 AS bottom", "3 AS right")
    merges = parts.where("p_size % 7 = 1").selectExpr("sheet", "row AS top", "2 AS left", "row AS bottom", "3 AS right")
    return stacked(areas, cells, merges, "area", "sheet").selectExpr("area", "cast(top AS bigint) AS top", "cast(left AS bigint) AS left", "cast(bottom AS bigint) AS bottom", "cast(right AS bigint) AS right")


def cell_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.create_map(F.lit(1), "p_name", F.lit(2), "p_type", F.lit(3), "p_brand").alias("cells"))
    return T.cell_page(rows, "p_partkey", "cells", 20, 60, [2, 3, 9]).select("p_partkey", F.array_join(F.array_sort(F.map_values("cells")), "|").alias("cells"))


def requested_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    asked = F.expr("concat('sheet \"', p_brand, '\" field «', p_name, '», row ', p_partkey * 900, ' column ', CASE WHEN p_size % 4 = 0 THEN 'ZZZ' ELSE 'AB' END, CASE WHEN p_size % 7 = 0 THEN ' row 5' ELSE '' END)")
    return rows.select("p_partkey", T.requested_cell(asked).alias("r")).select("p_partkey", "r.sheet", "r.field", "r.row", "r.col")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """One line for each number of an order."""
    some = [F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag")]
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*some)


def qualified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables of the columns Order and Part; every twentieth asks for its lines by both numbers."""
    lines = _lines(spark, d).withColumnRenamed("l_orderkey", "table").withColumnRenamed("l_linenumber", "row")
    queries = lines.where("table % 20 = 0").selectExpr("table * 10 + row AS q", "0 AS scope", "concat('which ORDER ', table + 1000, ' has part: ', l_partkey + 1000, ' and \"code 555\"') AS text")
    cells = lines.select("table", "row", F.posexplode(F.array((F.col("table") + 1000).cast("string"), (F.col("l_partkey") + 1000).cast("string"))).alias("index", "shown"))
    tables = lines.select("table").distinct().selectExpr("table", "0 AS scope")
    columns = tables.select("table", F.posexplode(F.array(F.array(F.lit("Order")), F.array(F.lit("Part")))).alias("index", "path"))
    return A.identified_rows(queries, tables, columns, cells).selectExpr("q", "table AS l_orderkey", "row AS l_linenumber")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of two sheets for each brand."""
    names = ["p_brand AS scope", "concat(p_brand, '/', p_size % 2) AS table", "concat(p_brand, ' s', p_size % 2) AS sheet"]
    return table(spark, d, "part").selectExpr("p_partkey AS k", "p_name", "p_size", "p_partkey + 1 AS row", *names)


def _columns(rows: DataFrame, *paths: list[str]) -> DataFrame:
    listed = F.array(*[F.array(*map(F.lit, p)) for p in paths])
    return rows.select("table").distinct().select("table", F.posexplode(listed).alias("index", "path")).withColumn("index", F.col("index") + 1)


def field_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Questions with labels that siblings, case endings, quotes and stray numbers change; the twin knows which are refused."""
    rows = _sheets(spark, d)
    codes = F.array((F.col("k") + 1000).cast("string"), (F.col("k") % 100 + 500).cast("string"), (F.col("k") + 3000).cast("string"))
    cells = rows.select("table", "row", F.posexplode(codes).alias("index", "shown")).withColumn("index", F.col("index") + 1)
    said = """CASE k % 8 WHEN 0 THEN concat('which part has Code ', k + 1000, '?') WHEN 1 THEN concat('что у кода: ', k + 3000)
        WHEN 2 THEN concat('all with BE=', k % 100 + 500) WHEN 3 THEN concat('code ', k % 100 + 500) WHEN 4 THEN concat('total 555 for code ', k + 1000)
        WHEN 5 THEN concat('code ', k + 1000, ' and 12.5 more') WHEN 6 THEN concat('code ', k + 1000, ' be # ', k % 100 + 500)
        ELSE concat('code «total 999» ', k + 1000, ', be: ', k % 100 + 501) END AS text"""
    tables = rows.select("table", "scope").distinct()
    return A.identified_rows(rows.selectExpr("k AS q", "scope", said), tables, _columns(rows, ["Part", "Code"], ["Part", "Code BE"], ["Код"]), cells)


def proven_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name asked for by sheet, field, row, column and code; some questions err, some cells are merged, missing or not stored."""
    rows = _sheets(spark, d)
    empty = F.col("k") % 10 == 3
    name = F.struct(F.when(empty, "").otherwise(F.col("p_name")).alias("shown"), F.when(empty, "formula_missing").otherwise("value").alias("state"), F.when(empty, "=A1").alias("formula"))
    plain = lambda c: F.struct(c.cast("string").alias("shown"), F.lit("value").alias("state"), F.lit(None).cast("string").alias("formula"))
    cells = rows.select("table", "row", "k", F.posexplode(F.array(plain(F.col("k") + 1000), name, plain(F.col("p_size")))).alias("i", "c")).where("NOT (i = 1 AND k % 5 = 2)")
    cells = cells.selectExpr("table", "row", "i + 1 AS index", "c.shown", "c.state", "nullif(c.shown, '') AS raw", "c.formula", "cast(null AS string) AS cached")
    tables = rows.groupBy("table", "scope", "sheet").agg(F.max("row").alias("bottom")).selectExpr("*", "NOT table LIKE '%1/0' AS complete", "array(1) AS header_rows", "1 AS top", "1 AS left", "3 AS right")
    merges = rows.where("p_size % 7 = 0").selectExpr("table", "row AS top", "row AS bottom", "1 AS left", "2 AS right")
    said = """concat('sheet "', lower(scope), '  S', p_size % 2, '" field «', CASE WHEN k % 5 = 1 THEN 'Size' ELSE 'name' END, '», row ', row, ' column B, code ', CASE WHEN k % 5 = 0 THEN k + 1001 ELSE k + 1000 END) AS text"""
    columns = _columns(rows, ["Part", "Code"], ["Part", "Name"], ["Size"])
    return A.proven_cells(rows.selectExpr("k AS q", "scope", said), tables, columns, cells, merges).select("q", "table", F.col("row").cast("long").alias("row"), "state", "shown")


def promoted_blocks(spark: SparkSession, d: str) -> DataFrame:
    return T.promoted(_lines(spark, d).drop("l_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity") > 25, F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "new_place")


_LINES = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)"
QUERIES = {f.__name__: f for f in (field_records, table_fragments, table_projection, table_previews, header_paths, stacked_tables, cell_page, requested_cells, qualified_rows, field_identifiers, proven_cells, promoted_blocks)}
ORACLES = {
    "field_records": """
SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_type AS type, p_size::VARCHAR AS length, CASE WHEN p_size > 25 THEN '1' ELSE '' END AS cardinality, 'about ' || p_name AS description FROM part""",
    "table_projection": """
WITH f AS (SELECT l_orderkey, l_linenumber, 'part ' || l_partkey || ' from ' || l_suppkey AS fragment FROM lineitem),
s AS (SELECT *, sum(length(fragment) + 1) OVER (PARTITION BY l_orderkey) <= 60 AS fits FROM f)
SELECT l_orderkey, 'table' AS kind, string_agg(fragment, chr(10) ORDER BY l_linenumber, fragment) AS fragment FROM s WHERE fits GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'row', fragment FROM s WHERE NOT fits""",
    "table_previews": """
WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k,
  [p_partkey::VARCHAR, replace(p_name, ' ', '_'), p_type, p_size::VARCHAR, CASE WHEN p_size > 25 THEN '1' ELSE '' END, 'about ' || p_name] AS c FROM part)
SELECT p_brand, 'No|Field name|Data type|Length|Cardinality|Description|No|Field name|Data type|Length|Cardinality|Description' AS columns,
string_agg(array_to_string(c || c, '|'), chr(10) ORDER BY k) AS shown FROM r WHERE k <= 3 GROUP BY p_brand""",
    "header_paths": """
SELECT sheet, col, 'order / group ' || (col - (col + 1) % 2) || CASE WHEN col = 3 THEN '' ELSE ' / ' || c_name END AS path
FROM (SELECT c_custkey // 7 AS sheet, (c_custkey % 7 + 1)::INT AS col, c_name FROM customer)""",
    "stacked_tables": """
WITH p AS (SELECT p_partkey // 40 AS area, p_partkey % 40 + 1 AS row, p_size % 3 = 0 AS head, p_size % 2 = 0 AS bold, p_size % 7 = 1 AS merged FROM part WHERE p_size % 5 <> 0),
s AS (SELECT *, coalesce(row > lag(row) OVER w + 1, false) AND head AND (merged OR bold AND NOT coalesce(lead(head) OVER w, true)) AS starts FROM p WINDOW w AS (PARTITION BY area ORDER BY row)),
k AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY area ORDER BY row) AS t FROM s),
g AS (SELECT area, t, CASE WHEN t = 0 THEN 1 ELSE min(row) END AS top, CASE WHEN bool_or(merged) THEN 3 ELSE 2 END AS "right" FROM k GROUP BY area, t)
SELECT area, top::BIGINT AS top, 1::BIGINT AS "left", coalesce(lead(top) OVER (PARTITION BY area ORDER BY top) - 1, 40)::BIGINT AS bottom, "right"::BIGINT AS "right" FROM g""",
    "cell_page": "SELECT p_partkey, array_to_string(list_sort([p_type, p_brand]), '|') AS cells FROM part WHERE p_partkey BETWEEN 20 AND 60",
    "requested_cells": """
WITH o AS (SELECT *, p_size % 4 <> 0 AND p_size % 7 <> 0 AND p_partkey * 900 BETWEEN 1 AND 1048576 AS ok FROM part)
SELECT p_partkey, CASE WHEN ok THEN p_brand END AS sheet, CASE WHEN ok THEN p_name END AS field, CASE WHEN ok THEN p_partkey * 900 END::INT AS row, CASE WHEN ok THEN 28 END::INT AS col FROM o""",
    "qualified_rows": f"""
WITH {_LINES} SELECT q.l_orderkey * 10 + q.l_linenumber AS q, r.l_orderkey, r.l_linenumber FROM l q JOIN l r
ON r.l_orderkey = q.l_orderkey AND r.l_partkey = q.l_partkey WHERE q.l_orderkey % 20 = 0""",
    "field_identifiers": """
WITH p AS (SELECT p_partkey AS k, p_brand AS s, p_brand || '/' || (p_size % 2) AS t, p_partkey % 100 AS be FROM part)
SELECT k AS q, t AS "table", k + 1 AS row FROM p WHERE k % 8 IN (0, 1, 6)
UNION ALL SELECT a.k, b.t, b.k + 1 FROM p a JOIN p b ON b.s = a.s AND b.be = a.be WHERE a.k % 8 = 2""",
    "proven_cells": """
SELECT p_partkey AS q, p_brand || '/' || (p_size % 2) AS "table", p_partkey + 1 AS row, CASE WHEN p_partkey % 5 = 2 THEN 'blank' WHEN p_partkey % 10 = 3 THEN 'formula_missing' ELSE 'value' END AS state,
CASE WHEN p_partkey % 5 = 2 OR p_partkey % 10 = 3 THEN '' ELSE p_name END AS shown
FROM part WHERE p_partkey % 5 > 1 AND p_size % 7 <> 0 AND NOT (p_brand LIKE '%1' AND p_size % 2 = 0) AND p_partkey + 1 > 1""",
    "promoted_blocks": f"""
WITH {_LINES}, r AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS t,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag <> 'N' ORDER BY l_linenumber) AS old,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag <> 'N' ORDER BY CASE WHEN l_returnflag <> 'N' THEN l_quantity <= 25 END, l_linenumber) AS new FROM l)
SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS new_place FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.t = a.t AND b.old = a.new""",
}
