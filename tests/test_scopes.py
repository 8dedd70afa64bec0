"""Evidence and scopes on small tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evidence as E
from corpusmill.operators import scopes as S


def test_forms_stand_by_themselves(spark):
    texts = ["see P0002.", "see P0002-PERIOD", "XP0002", "/P0002", "(p0002)", "P0002.P", "a  b c", "ab c", None, r"x \E y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    row = lambda c: [r[0] for r in df.orderBy("i").select(c).collect()]
    assert row(E.holds_form(F.col("t"), ["P0002"], "identifier")) == [True, False, False, False, True, False, False, False, False, False]
    assert row(E.holds_form(F.col("t"), ["P0002"])) == [True, True, False, True, True, True, False, False, False, False]
    assert row(E.holds_form(F.col("t"), ["A B", r"\E"])) == [False] * 6 + [True, False, False, True]
    assert row(E.holds_form(F.col("t"), ["", " "])) == [False] * 10
    negated = spark.createDataFrame([("Это не так",), ("nothing",), ("No!",), ("без_",), (None,)], "t string").select(E.has_negation(F.col("t")))
    assert [r[0] for r in negated.collect()] == [True, False, True, False, False]


def test_quotes_and_lines(spark):
    text = "one two\n three one  two four\n\nlast"
    cases = [("three one two", (9, 23)), ("one two", None), ("", None), ("four last", (24, 34)), ("absent", None), ("(", None)]
    df = spark.createDataFrame([(text, q) for q, _ in cases], "t string, q string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(E.unique_quote(F.col("t"), F.col("q"))).collect()]
    assert got == [span for _, span in cases]
    once = spark.createDataFrame([("aXaXa", "aXa")], "t string, q string")
    assert once.select(E.unique_quote(F.col("t"), F.col("q"))).first()[0] is None
    spans = [(0, 1), (1, 3), (3, 4), (3, 5), (2, 2), (-1, 1)]
    df = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int")
    offsets = [0]
    for line in text.splitlines(keepends=True):
        offsets.append(offsets[-1] + len(line))
    want = [(offsets[a], offsets[b]) if 0 <= a < b < len(offsets) else None for a, b in spans]
    got = [tuple(r[0]) if r[0] else None for r in df.select(E.line_span(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == want


def test_retained_excerpts(spark):
    run = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = f"Before it. {run}, and more words after it. Then a b c d e f g h."
    pairs = [(1, text, run), (2, text, "a b c d e f g h"), (3, f"{run} {run}", run), (4, text, " ".join(run.split()[:7])), (5, None, run), (6, text, f"new start {run} new end of it all")]
    got = {r.k: [(s.start, s.end) for s in r.spans] for r in E.retained_excerpts(spark.createDataFrame(pairs, "k long, t string, e string"), "k", "t", "e").collect()}
    at = text.index("alpha")
    assert got == {1: [(at, at + len(run))], 2: [], 3: [], 4: [], 5: [], 6: [(at, at + len(run))]}


def test_halves():
    assert E.halves("one unit") == ["one unit"] and E.halves("") == [""]
    assert E.halves("aaaa\n\nbb\n\ncccc") == ["aaaa\n\nbb", "cccc"]
    assert E.halves("```\na\n\nb\n```\n\nrest") == ["```\na\n\nb\n```", "rest"]
    table = "# T\n| a | b |\n|---|---|\n" + "\n".join(f"| {k} | x |" for k in range(4))
    first, second = E.halves(table)
    assert first.split("\n")[:3] == second.split("\n")[:3] == table.split("\n")[:3]
    assert re.findall(r"\| (\d) ", first + second) == ["0", "1", "2", "3"] and first.count("x") == second.count("x") == 2


def test_scopes(spark):
    with pytest.raises(ValueError):
        S.mail_allowed(F.lit("mail"), "some")
    df = spark.createDataFrame([("mail",), ("document",), ("unknown",), (None,)], "s string")
    seen = {m: [r[0] for r in df.select(S.mail_allowed(F.col("s"), m)).collect()] for m in S.MAIL_MODES}
    assert seen == {"all": [True] * 4, "exclude": [False, True, False, False], "only": [True, False, False, False]}
    blocks = spark.createDataFrame([(1, [(1, True)]), (2, []), (3, None), (4, [(4, None)]), (5, [(6, True)])], "id long, parts array<struct<id:long,verified:boolean>>")
    block = {"verified": F.lit(True), "scope": F.lit("document"), "id": F.col("id")}
    parts = F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["verified"].alias("verified"), F.lit("document").alias("scope")))
    assert [r.id for r in blocks.where(S.proven(block, parts, ["id"], "exclude")).collect()] == [1]
    assert blocks.where(S.proven(block, parts, ["id"], "all")).count() == 5


def test_repeated_cells_each_meet_all_ranges_of_their_place(spark):
    from corpusmill.operators import scopes

    cells = spark.createDataFrame([(k, s, r, c) for k, (s, r, c) in enumerate([(1, 2, 3)] * 4 + [(1, 2, 9), (2, 2, 3), (None, 2, 3)])], "k int, sheet int, row int, col int")
    merges = spark.createDataFrame([(1, 1, 3, 2, 3, 10), (1, 2, 2, 3, 4, 11), (2, 5, 6, 3, 3, 12)], "sheet int, top int, bottom int, left int, right int, merge_id int")
    got = scopes.merged(cells, merges).select("k", "merge_id").collect()
    assert sorted(map(tuple, got)) == [(k, m) for k in range(4) for m in (10, 11)]


def test_a_scope_of_many_turns_takes_no_frame_up_to_the_end(spark):
    from corpusmill.operators import scopes

    rows = [("g", f"n{k}", None, None, 1 + k % 3) for k in range(40)] + [("g", "m", "n7", "barred", 1)]
    nodes = spark.createDataFrame(rows, "g string, node string, parent string, why string, rows int")
    out = scopes.recommended(nodes, ["g"], "node", "parent", "why", {"rows": 30})
    order = sorted(rows[:-1], key=lambda r: (-r[4], r[1]))
    stays = [r[1] for k, r in enumerate(order) if sum(x[4] for x in order[k:]) < 30]
    assert sorted(r.node for r in out.where("included").collect()) == sorted(stays)
    # such a frame is summed anew for each row: squared in the rows of a group
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_cells_of_many_ranges_are_dealt_to_several_tasks(spark, monkeypatch):
    from corpusmill import session
    from corpusmill.operators import scopes

    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    monkeypatch.setattr(scopes, "DEALT_ROWS", 100)
    cells = spark.createDataFrame([(k, 1, k % 8, 3) for k in range(160)] + [(k, None, 1, 3) for k in range(9)], "k int, sheet int, row int, col int")
    merges = spark.createDataFrame([(1, 0, 9, 2, 3, m) for m in range(20)], "sheet int, top int, bottom int, left int, right int, merge_id int")
    got = scopes.merged(cells, merges)
    tasks = got.rdd.glom().map(len).collect()
    assert sum(tasks) == 160 * 20 and sum(t > 0 for t in tasks) > 2
    assert scopes.merged(cells.limit(0), merges).count() == 0
