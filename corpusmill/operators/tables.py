"""Tables as rows of cells: field records, header paths, fragments, previews, and cells that a question names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, column_number

# Words of header cells that name a column, and the shape of names and row numbers.
NAME_KEYS = ("поле", "элемент", "атрибут", "field", "element", "attribute", "feld", "имя", "наименован", "тег", "tag", "name")
TYPE_KEYS = ("тип", "type", "typ")
LENGTH_KEYS = ("длина", "length", "огранич")
NUMBER_KEYS = ("кратност", "обязат", "cardinality", "required", "множ", "вхож")
TEXT_KEYS = ("описан", "description", "comment")
FIELD_NAME = r"^[A-Za-zÀ-ÖØ-öø-žА-Яа-яЁё_][A-Za-zÀ-ÖØ-öø-žА-Яа-яЁё0-9_\-.]*$"
ROW_NUMBER = r"^\d+(\.\d+)*$"
QUOTE = r'\s*(?:«([^»]+)»|“([^”]+)”|"([^"]+)")'
ROW_ASKED = r"(?iU)(?:строк[аеуи]|row)\s+([0-9]+)(?![\w.,])"
ROWS, COLUMNS = 1_048_576, 16_384
PREVIEW_COLUMNS, PREVIEW_ROWS, PREVIEW_CHARS = 12, 3, 160


def _column_of(header: Column, keys: tuple[str, ...]) -> Column:
    """Place, from 0, of the first header cell that holds one of the keys; -1 without one."""
    return F.array_position(F.transform(header, lambda h: F.lower(h).rlike("|".join(keys))), True).cast("int") - 1


def _name_place(cells: Column) -> Column:
    """The first cell names the field, the second one if the first numbers the row."""
    return F.when(F.get(cells, F.lit(0)).rlike(ROW_NUMBER), 1).otherwise(0)


def is_field_table(header: Column, rows: Column) -> Column:
    """Whether a table describes fields: its header names a field and a type, and two of its first three rows (all, if fewer) a field."""
    sample = F.slice(rows, 1, 3)
    named = F.size(F.filter(sample, lambda r: F.coalesce(F.trim(F.get(r, _name_place(r))).rlike(FIELD_NAME), F.lit(False))))
    return (_column_of(header, NAME_KEYS) >= 0) & (_column_of(header, TYPE_KEYS) >= 0) & (named >= F.least(F.lit(2), F.size(sample)))


def field_record(header: Column, cells: Column) -> Column:
    """(name, type, length, cardinality, description) of a row by its header, else by place; null for a row that names no field."""

    def record(at: Column) -> Column:
        cell = lambda i: F.coalesce(F.trim(F.get(cells, F.when((i >= 0) & (i < F.size(cells)), i))), F.lit(""))
        found = lambda keys, place: bound(_column_of(header, keys), lambda i: F.when((i < 0) & (F.size(cells) > at + place), at + place).otherwise(i))
        kind, length, number = found(TYPE_KEYS, 1), found(LENGTH_KEYS, 2), found(NUMBER_KEYS, 3)
        last = F.size(cells) - 1
        taken = (last == kind) | (last == length) | (last == number) | (last == at)
        text = bound(_column_of(header, TEXT_KEYS), lambda i: F.when(i >= 0, i).when(taken, F.greatest(at + 4, last)).otherwise(last))
        described = F.when(text == at, "").otherwise(cell(text))
        return F.when(
            F.get(cells, at).rlike(FIELD_NAME),
            F.struct(
                cell(at).alias("name"), cell(kind).alias("type"), F.when(length == kind, "").otherwise(cell(length)).alias("length"),
                F.when(number == kind, "").otherwise(cell(number)).alias("cardinality"),
                F.when((described == "") & (F.size(cells) > 1), cell(last)).otherwise(described).alias("description"),
            ),
        )

    return bound(_name_place(cells), record)


def compacted(header: Column, rows: Column) -> Column:
    """(header, rows) without the empty columns at the end, if every row has the header's width; else as they are."""
    used = F.array_max(F.transform(F.concat(F.array(header), rows), lambda r: F.array_max(F.transform(r, lambda c, i: F.when(F.trim(c) != "", i + 1).otherwise(0)))))
    width = F.when(F.forall(rows, lambda r: F.size(r) == F.size(header)), F.greatest(used, F.lit(1))).otherwise(F.size(header))
    return bound(width, lambda n: F.struct(F.slice(header, 1, n).alias("header"), F.transform(rows, lambda r: F.slice(r, 1, F.when(n < F.size(header), n).otherwise(F.size(r)))).alias("rows")))


def header_paths(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, col, path): the header cells (sheet, row, col, value) above each column from the top; a merged range (sheet, top,
    bottom, left, right) gives all its columns the value of its first cell, and equal neighbours on a path are one step."""
    spread = merges.select("sheet", F.col("top").alias("row"), F.col("left").alias("col"), "right").where("right > col")
    rows = cells.where("trim(value) <> ''").join(spread, ["sheet", "row", "col"], "left")
    wide = rows.select("sheet", "row", F.explode(F.sequence("col", F.coalesce("right", "col"))).alias("col"), F.col("col").alias("_from"), "value")
    own = wide.groupBy("sheet", "row", "col").agg(F.max_by("value", "_from").alias("value"))  # a cell's own value wins
    steps = own.groupBy("sheet", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("path"))
    return steps.withColumn("path", F.filter("path", lambda x, i: (i == 0) | (x != F.get(F.col("path"), F.greatest(i - 1, F.lit(0))))))


def row_fragments(rows: DataFrame, keys: list[str], header: str, cells: str, limit: int) -> DataFrame:
    """(keys, part, fragment, first, last): "header: value" lines of a row's filled cells, packed in order into fragments of at most
    ``limit`` characters; a longer line is cut into pieces. first and last: places of the cells, from 0."""
    lines = F.filter(F.transform(F.arrays_zip(F.col(header).alias("h"), F.col(cells).alias("c")), lambda x, i: F.struct(i.alias("i"), F.concat_ws(": ", x["h"], x["c"]).alias("t"), x["c"].alias("c"))), lambda x: F.coalesce(x["c"], F.lit("")) != "")
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x["t"]) - 1) / limit).cast("int")), lambda k: F.struct(x["i"].alias("i"), F.substring(x["t"], k * limit + 1, F.lit(limit)).alias("t")))))
    kind = "array<struct<first:int,last:int,t:string>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(F.try_element_at(acc, F.lit(-1))["t"]) + 1 + F.length(x["t"]) <= limit)
        joined = F.struct(last["first"].alias("first"), x["i"].alias("last"), F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"))
        fresh = F.struct(x["i"].alias("first"), x["i"].alias("last"), x["t"].alias("t"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    packed = F.aggregate(pieces, F.array().cast(kind), lambda acc, x: add(acc, x).cast(kind))
    return rows.select(*keys, F.posexplode(packed).alias("part", "_f")).select(*keys, "part", F.col("_f.t").alias("fragment"), F.col("_f.first").alias("first"), F.col("_f.last").alias("last"))


def projected(fragments: DataFrame, table: str, order: list[str], limit: int) -> DataFrame:
    """(table, kind, fragment, ...): a table whose fragments fit ``limit`` characters together, line ends between, is one fragment
    ("table"); others keep theirs ("row"). Only tables that fit are gathered."""
    sizes = fragments.groupBy(table).agg((F.sum(F.length("fragment") + 1) <= limit).alias("_fits"))
    marked = fragments.join(sizes, table)
    whole = marked.where("_fits").groupBy(table).agg(F.array_sort(F.collect_list(F.struct(*order, "fragment"))).alias("_f"))
    whole = whole.select(table, F.lit("table").alias("kind"), F.array_join(F.transform("_f", lambda x: x["fragment"]), "\n").alias("fragment"))
    return whole.unionByName(marked.where("NOT _fits").select(table, F.lit("row").alias("kind"), "fragment"))


def previews(rows: DataFrame, table: str, number: str, header: str, cells: str) -> DataFrame:
    """(table, columns, rows): the first and last columns and the first rows of each table, all clipped."""
    half = PREVIEW_COLUMNS // 2
    some = lambda a: F.when(F.size(a) <= PREVIEW_COLUMNS, a).otherwise(F.concat(F.slice(a, 1, half), F.slice(a, -half, half)))
    clip = lambda a: F.transform(some(a), lambda x: F.substring(F.coalesce(x, F.lit("")), 1, PREVIEW_CHARS))
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(table).orderBy(number))).where(F.col("_k") <= PREVIEW_ROWS)
    listed = first.select(table, "_k", clip(F.col(header)).alias("_h"), clip(F.col(cells)).alias("_c"))
    gathered = listed.groupBy(table).agg(F.min_by("_h", "_k").alias("columns"), F.array_sort(F.collect_list(F.struct("_k", "_c"))).alias("_r"))
    return gathered.select(table, "columns", F.transform("_r", lambda x: x["_c"]).alias("rows"))


def cell_page(rows: DataFrame, number: str, cells: str, first: int, last: int, columns: list[int]) -> DataFrame:
    """Rows first to last with the cells of some columns (a map from column number to value)."""
    return rows.where(F.col(number).between(first, last)).withColumn(cells, F.map_filter(cells, lambda k, _: k.isin(*columns)))


def requested_cell(asked: Column, rows: int | None = ROWS) -> Column:
    """(sheet, field, row, col) of a question that names exactly one of each, with a row and a column that a sheet has; else null.
    ``rows``: the last row of a sheet; None if the reader bounds rows by tables."""
    once = lambda pattern: F.regexp_count(asked, F.lit(pattern)) == 1
    first = lambda pattern, groups: F.coalesce(*[F.nullif(F.regexp_extract(asked, pattern, g), F.lit("")) for g in range(1, groups + 1)])
    sheet, named = r"(?iU)(?:лист(?:е|а)?|sheet)" + QUOTE, r"(?iU)(?:пол(?:е|я)|field)" + QUOTE
    row, col = ROW_ASKED, r"(?iU)(?:колонк[аеуи]|столб(?:ец|це|ца)|column)\s+([A-Z]{1,3})(?!\w)"
    n, c = first(row, 1).try_cast("int"), column_number(F.upper(first(col, 1)))
    whole = F.struct(first(sheet, 3).alias("sheet"), first(named, 3).alias("field"), n.alias("row"), c.alias("col"))
    return F.when(once(sheet) & once(named) & once(row) & once(col) & (n.between(1, rows) if rows else n >= 1) & c.between(1, COLUMNS), whole)


def promoted(blocks: DataFrame, key: str, place: str, complete: Column, has_table: Column) -> DataFrame:
    """Blocks with their new place: among the places of table blocks the complete ones come first, each group in its old order."""
    old = W.partitionBy(key, has_table).orderBy(place)
    new = W.partitionBy(key, has_table).orderBy(F.when(has_table, ~complete), place)
    ranked = blocks.withColumns({"_t": has_table, "_old": F.row_number().over(old), "_new": F.row_number().over(new)})
    slots = ranked.select(F.col(key), F.col("_t"), F.col("_old").alias("_new"), F.col(place).alias("new_place"))
    return ranked.join(slots, [key, "_t", "_new"]).select(*blocks.columns, "new_place")
