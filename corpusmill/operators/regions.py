"""Tables that are stacked in one area of a sheet: where the next one starts, by heads, captions, gaps and merged cells."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .areas import EDGES
from .folds import folded

#: Fixed value: rows of a body before a title across the whole area starts a table without a gap.
BODY = 8


def row_signs(areas: DataFrame, cells: DataFrame, merges: DataFrame, area: str, sheet: str) -> DataFrame:
    """(area, row, signs...) of the rows of each area that show something. cells: (sheet, row, col, text, kind, formula, bold); kind: string, number
    or another of a value, null for none; merges: rectangles of the sheet."""
    held = areas.select(area, sheet, *EDGES)
    shown, known = F.coalesce(F.col("text"), F.lit("")) != "", F.col("kind").isNotNull()
    value, formula, string = shown & known, F.coalesce("formula", F.lit(False)), F.coalesce(F.col("kind") == "string", F.lit(False))
    inside = cells.join(held, sheet).where("row BETWEEN top AND bottom AND col BETWEEN left AND right")
    n = lambda c: F.count_if(c)
    signs = inside.groupBy(area, "row").agg(
        n(shown).alias("shown"), n(shown | formula).alias("filled"), n(value).alias("values"), n(value & string & ~formula).alias("texts"), n(value & string).alias("strings"),
        n(value & (formula | ~F.col("kind").isin("string", "number"))).alias("odd"), F.min_by(string, F.when(value, F.col("col"))).alias("first"),
        n(known & ~string).alias("numbers"), F.bool_or(F.coalesce("bold", F.lit(False))).alias("bold"),
        F.min(F.when(shown | formula, F.col("col"))).alias("low"), F.max(F.when(shown | formula, F.col("col"))).alias("high"),
    ).where("filled > 0")
    signs = signs.withColumns({"head": F.expr("values >= 2 AND texts = values"), "label": F.expr("values > 0 AND coalesce(first, false) AND strings >= 2 AND strings * 2 >= values AND odd = 0")})
    m = merges.select(sheet, *[F.col(c).alias(f"m_{c}") for c in EDGES])
    over = held.join(m, sheet).where("m_left <= right AND m_right >= left")
    wide, flat = F.expr("m_right > m_left"), F.expr("m_bottom = m_top")
    own = over.where("m_left >= left AND m_right <= right AND m_left <= m_right").groupBy(area, F.col("m_top").alias("row")).agg(
        F.bool_or(wide | F.expr("m_bottom > m_top")).alias("joined"), F.bool_or(wide & flat).alias("across"), F.bool_or(flat & F.expr("m_left = left AND m_right = right")).alias("whole"),
        F.min("m_left").alias("m_low"), F.max("m_right").alias("m_high"),
    )
    crossed = signs.select(area, "row").join(over.select(area, "m_top", "m_bottom"), area).where("m_top < row AND row <= m_bottom").select(area, "row").distinct().withColumn("crossed", F.lit(True))
    out = signs.join(own, [area, "row"], "left").join(crossed, [area, "row"], "left").fillna(False, ["joined", "across", "whole", "crossed"])
    order = W.partitionBy(area).orderBy("row")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.lit(False))
    one = F.col("shown") == 1
    out = out.withColumns({"gap": F.col("row") > F.lag("row").over(order) + 1, "next_label": nxt("label"), "next_bold": nxt("bold"), "next_number": nxt(F.col("numbers") > 0)})
    section = one & F.col("next_label") & (F.col("across") | F.col("next_bold"))
    starts = F.coalesce("gap", F.lit(False)) & (F.col("head") & (F.col("joined") | F.col("bold") & F.col("next_number")) | section)
    return out.select(
        area, "row", F.least("low", "m_low").alias("low"), F.greatest("high", "m_high").alias("high"), (starts & ~F.col("crossed")).alias("starts"),
        (one & F.col("whole") & section & ~F.col("crossed")).alias("titles"),
    )


def stacked(areas: DataFrame, cells: DataFrame, merges: DataFrame, area: str, sheet: str) -> DataFrame:
    """(area, top, left, bottom, right): each area cut into the tables that are stacked in it, the columns drawn in to what they show.

    A row starts a table behind a gap if it is a head (texts only, with merged cells, or bold above numbers) or the caption of a row of
    labels; or, without a gap, if it is a title across the whole area and the open table has more than BODY rows. A row that a merged
    cell from above reaches starts none. Only the last rule looks back at what was decided, so signs come from windows and a
    fold carries nothing but the open table's first row. An area that shows nothing stays as it is.
    """
    signs = row_signs(areas, cells, merges, area, sheet).join(areas.select(area, "top", "left", "bottom", "right"), area)

    def step(state: list, row: int, top: int, starts: bool, titles: bool) -> list[tuple]:
        first = top if state[0] is None else state[0]
        state[0] = row if starts or titles and row > first + BODY else first
        return [(state[0],)]

    placed = folded(signs, area, ["row"], ["row", "top", "starts", "titles"], [("start", "long", pa.int64())], lambda: [None], step)
    tables = placed.groupBy(area, "start").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("bottom").alias("end"))
    after = F.lead("start").over(W.partitionBy(area).orderBy("start"))
    # a start in the area's first row leaves nothing in front of it
    found = tables.select(area, F.col("start").alias("top"), F.col("low").alias("left"), F.coalesce(after - 1, F.col("end")).alias("bottom"), F.col("high").alias("right"))
    empty = areas.join(found.select(area).distinct(), area, "left_anti").select(area, *EDGES)
    return found.unionByName(empty)
