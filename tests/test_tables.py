"""Tables on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tables as T


@pytest.mark.parametrize("limit", [7, 20, 1000])
def test_row_fragments_lose_nothing(spark, limit):
    header = ["a", "bb", None, "d"]
    rows = [(1, header, ["x" * 30, "", "y", "z"]), (2, header, ["", None, "", ""]), (3, header, ["1", "2", "3", "4", "5"])]
    df = spark.createDataFrame(rows, "id long, header array<string>, cells array<string>")
    got: dict[int, list] = {}
    for r in T.row_fragments(df, ["id"], "header", "cells", limit).orderBy("id", "part").collect():
        assert len(r.fragment) <= limit and r.first <= r.last
        got.setdefault(r.id, []).append(r)
    assert got.keys() == {1, 3}
    for i, _, cells in rows:
        lines = [": ".join(x for x in (h, c) if x is not None) for h, c in zip(header + [None], cells, strict=False) if c]
        pieces = [line[k : k + limit] for line in lines for k in range(0, len(line), limit)]
        want: list[str] = []
        for piece in pieces:
            if want and len(want[-1]) + 1 + len(piece) <= limit:
                want[-1] += "\n" + piece
            else:
                want.append(piece)
        assert [r.fragment for r in got.get(i, [])] == want


def test_field_tables(spark):
    header = ["Поле", "Тип", "Описание"]
    df = spark.createDataFrame(
        [(1, header, [["Name", "string", "d"], ["1", "x", "y"]]), (2, header, [["a b", "c", "d"], ["c d", "e", "f"]]), (3, ["x", "y"], [["Name", "s"]]), (4, header, [["ok", "t", ""]])],
        "id int, header array<string>, rows array<array<string>>",
    )
    assert [r[0] for r in df.orderBy("id").select(T.is_field_table(F.col("header"), F.col("rows"))).collect()] == [True, False, False, True]
    rows = df.where("id = 1").select("header", F.explode("rows").alias("c")).select(T.field_record(F.col("header"), F.col("c")).alias("r")).collect()
    assert tuple(rows[0].r)[:2] == ("Name", "string") and rows[0].r.description == "d" and rows[1].r.name == "x"
    bad = spark.createDataFrame([(["a"], ["not a name"]), (["a"], [])], "h array<string>, c array<string>")
    assert [r[0] for r in bad.select(T.field_record(F.col("h"), F.col("c"))).collect()] == [None, None]


def test_empty_columns_at_the_end_go(spark):
    rows = [(["a", "b", ""], [["1", "", ""], ["2", " ", ""]]), (["a", "b", ""], [["1", "", ""], ["2"]]), (["", ""], [["", ""]]), (["a", "b"], [["", "x"]])]
    df = spark.createDataFrame(rows, "h array<string>, r array<array<string>>")
    got = [(r[0].header, r[0].rows) for r in df.select(T.compacted(F.col("h"), F.col("r"))).collect()]
    assert got == [(["a", "b"], [["1", ""], ["2", " "]]), rows[1], ([""], [[""]]), rows[3]]


def test_requested_cells_name_one_of_each(spark):
    cases = [
        ('лист «Итог» поле "Код", строка 12 столбец AB', ("Итог", "Код", 12, 28)), ("sheet “S” field «F» row 1 column a", ("S", "F", 1, 1)),
        ('sheet "S" field "F" row 1 row 2 column A', None), ('sheet "S" field "F" row 1.5 column A', None), ('sheet "S" row 1 column A', None), (None, None),
    ]
    df = spark.createDataFrame([(q,) for q, _ in cases], "q string").select(T.requested_cell(F.col("q")))
    assert [tuple(r[0]) if r[0] else None for r in df.collect()] == [want for _, want in cases]


def test_rows_of_any_number_of_digits_are_asked_for(spark):
    cases = ['sheet "S" field "F" row 18000000 column A row 5', 'sheet "S" field "F" row 99999999999 column A', 'sheet "S" field "F" row 1048577 column A']
    df = spark.createDataFrame([(q,) for q in cases], "q string").select(T.requested_cell(F.col("q")))
    assert [r[0] for r in df.collect()] == [None] * 3
