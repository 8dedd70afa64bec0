"""Spans, plans, packing, areas and scopes against brute force on small tables."""

from __future__ import annotations

import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from corpusmill.operators import evidence, folds, scopes, spans
from corpusmill.operators.areas import subtracted

TYPED = ["İstanbul  P0002", " été ÉTÉ\n\tETE", "P0002-X P0002. (p0002)", "a/P0002 :P0002: P0002--", "aaa aa aaaa", "new york city", " x y ", "", None, "ﬁ ﬀ ß", "é", "́x", "a b c a b"]
FORMS = [
    (1, "istanbul", "phrase"), (2, "été", "phrase"), (3, "P0002", "identifier"), (4, "aa", "phrase"), (5, "new york", "phrase"), (6, "york city", "phrase"), (6, "new york city", "phrase"),
    (7, "x y", "phrase"), (8, "shared", "phrase"), (9, "SHARED ", "phrase"), (10, "a b", "phrase"), (11, "b c", "phrase"), (12, "ete", "phrase"), (13, "  ", "phrase"), (14, "c", "identifier"),
]


def normalised(text):
    """As mapped(), character for character in another way."""
    out = []
    for i, c in enumerate(text):
        if i and unicodedata.combining(c):
            out[-1][0] += c
            out[-1][2] = i + 1
        else:
            out.append([c, i, i + 1])
    flat = []
    for c, a, b in out:
        for x in " " if c.isspace() else unicodedata.normalize("NFC", c).lower().replace("̇", ""):
            x = " " if x.isspace() else x
            if x == " " and flat and flat[-1][0] == " ":
                flat[-1] = (" ", flat[-1][1], b)
            else:
                flat.append((x, a, b))
    while flat and flat[0][0] == " ":
        flat.pop(0)
    while flat and flat[-1][0] == " ":
        flat.pop()
    return flat


def inner(c):
    return c.isalnum() or c == "_"


def places(text, norm, mode):
    flat = normalised(text)
    low, at = "".join(c for c, _, _ in flat), 0
    while (at := low.find(norm, at)) >= 0:
        end = at + len(norm)
        if mode == "identifier":
            left, right = low[:at].rstrip(".:-")[-1:], low[end:].lstrip(".:-")[:1]
            ok = not any(c and (inner(c) or c == "/") for c in (left, right))
        else:
            ok = not (at and inner(low[at - 1]) and inner(norm[0])) and not (end < len(low) and inner(low[end]) and inner(norm[-1]))
        if ok:
            yield flat[at][1], flat[end - 1][2]
        at = end


def expected_spans(text, forms):
    owners = {}
    for t, f, _ in forms:
        owners.setdefault(spans.normal(f), set()).add(t)
    found = [(a - b, a, t, n, b, f) for t, f, m in forms if (n := spans.normal(f)) and len(owners[n]) == 1 for a, b in places(text, n, m)]
    taken = []
    for x in sorted(found):
        if all(x[4] <= y[1] or y[4] <= x[1] for y in taken):
            taken.append(x)
    return {(t, f, a, b, text[a:b]) for _, a, t, _, b, f in taken}


def test_normalisation_keeps_places():
    rng = random.Random(2)
    alphabet = ["a", "B", "É", "é", "İ", " ", "\n", " ", "́", "ß", "🙂", "-"]
    for text in [t for t in TYPED if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        want = normalised(text)
        assert spans.mapped(text) == ("".join(c for c, _, _ in want), [a for _, a, _ in want], [b for _, _, b in want])


def test_spans_of_the_typed_query(spark):
    rng = random.Random(6)
    more = [" ".join(rng.choice(["a", "b", "c", "new", "york", "city", "P0002", "p0002.", "aa-", "x", "été", "shared"]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    typed = spark.createDataFrame(list(enumerate(TYPED + more)), "q int, t string")
    known = spans.keyed(spark.createDataFrame([(*f, True, True) for f in FORMS], "term_id long, form string, mode string, can_trigger boolean, can_search boolean")).cache()
    want = {(i, *x) for i, t in enumerate(TYPED + more) if t for x in expected_spans(t, FORMS)}
    for most in (spans.MOST_FORMS, 3):
        at = spans.occurrences(typed, known, "q", "t", most)
        assert {tuple(r) for r in spans.spans(at, known, "q").collect()} == want
    refused = spans.refused(spans.occurrences(typed, known, "q", "t"), known, "q").collect()
    assert {r.q for r in refused} == {i for i, t in enumerate(TYPED + more) if t and "shared" in t} and {r.term_id for r in refused} == {8, 9}
    assert spans.occurrences(typed.where("false"), known, "q", "t").collect() == [] == spans.spans(spans.occurrences(typed, known.where("false"), "q", "t"), known, "q").collect()


def test_plans_keep_budgets(spark):
    forms = [(t, f"term{t}", "phrase", True, True) for t in range(1, 8)] + [(1, f"other{k}", "phrase", False, True) for k in range(6)]
    forms += [(2, "x" * 800, "phrase", False, True), (3, " ".join(["w1"] * 33), "phrase", False, True), (4, "plain", "phrase", False, True), (4, "hidden", "phrase", False, False), (5, "other1", "phrase", False, True)]
    known = spark.createDataFrame(forms, "term_id long, form string, mode string, can_trigger boolean, can_search boolean")
    asked = spark.createDataFrame([(1, "term4 and"), (2, "nothing"), (3, "term1"), (4, "term2 term3"), (5, " ".join(f"term{t}" for t in range(7, 0, -1))), (6, "term4 plain"), (7, None), (8, "term1 term5")], "q int, t string")
    got = {r.q: (r.status, r.added, [(s.term_id, s.reason) for s in r.skipped]) for r in spans.plans(asked, known, "q", "t").collect()}
    assert got[1] == ("applied", ["plain"], []) and got[2] == ("no_match", [], []) == got[7] and got[6] == ("applied", [], [])
    assert got[3] == ("limited", ["other0", "other1", "other2", "other3"], [(1, "max_added_aliases_per_term")])
    assert got[4] == ("limited", [], [(2, "max_added_chars"), (3, "max_added_tokens")])
    assert got[5][1] == ["other1", "plain"] and got[5][2][-2:] == [(2, "max_terms_per_query"), (1, "max_terms_per_query")]
    assert got[8][1] == ["other0", "other1", "other2", "other3"]
    text = {r.q: r.expanded for r in spans.plans(asked, known, "q", "t").collect()}
    assert text[1] == "term4 and\nplain" and text[2] == "nothing"


def test_joints_of_any_length(spark):
    df = spark.createDataFrame([("x" + "-" * 40 + "P0002",), ("P0002" + "." * 99 + "y",), ("--P0002--",), ("/-P0002",), ("é:P0002",), ("P0002",)], "t string")
    assert [r[0] for r in df.select(evidence.holds_form(F.col("t"), ["P0002"], "identifier")).collect()] == [False, False, True, False, False, True]


def test_packing(spark):
    table = "|h|\n|-|\n" + "".join(f"|row {k}|\n" for k in range(9))
    rows = [("g", 1, "a" * 30), ("g", 2, "b" * 30), ("g", 3, table), ("g", 4, "c" * 99), ("g", 5, "d" * 10), ("h", 1, None), ("h", 2, "x\n" + "y" * 90 + "\nz\n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    full = folds.packed(df, "g", "i", "t", mode="full", limit=64, head=2, between=1).orderBy("g", "i", "piece").collect()
    got = [(r.g, r.i, r.batch, r.piece, r.shown) for r in full]
    head = "|h|\n|-|\n"
    cut = [head + "".join(f"|row {k}|\n" for k in part) for part in (range(6), range(6, 9))]
    assert got == [(None, 1, 0, 0, "n"), ("g", 1, 0, 0, "a" * 30), ("g", 2, 1, 0, "b" * 30), ("g", 3, 2, 0, cut[0]), ("g", 3, 3, 1, cut[1]), ("g", 4, None, 0, None), ("g", 5, 3, 0, "d" * 10), ("h", 1, 0, 0, ""), ("h", 2, None, 0, None)]
    fast = folds.packed(df, "g", "i", "t", mode="fast", limit=64, head=2, between=1).orderBy("g", "i").collect()
    assert [(r.g, r.i, r.shown) for r in fast] == [(None, 1, "n"), ("g", 1, "a" * 30), ("g", 5, "d" * 10), ("h", 1, ""), ("h", 2, "x\n")]


def test_folds_carry_state_over_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a" if k % 3 else "b", k, k % 10 + 1) for k in range(200)]
        got = folds.with_parts(spark.createDataFrame(rows, "g string, i int, n int"), "g", "i", "n", 25).collect()
        for g in "ab":
            part, held, want = 0, 0, []
            for _, i, n in [r for r in rows if r[0] == g]:
                if want and held + n > 25:
                    part, held = part + 1, 0
                held += n
                want.append((i, part))
            assert sorted((r.i, r.part) for r in got if r.g == g) == want
        assert folds.with_parts(spark.createDataFrame([], "g string, i int, n int"), "g", "i", "n", 25).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_areas_without_cuts(spark):
    rng = random.Random(8)
    box = lambda: (t := rng.randint(0, 9), x := rng.randint(0, 9), t + rng.randint(-1, 6), x + rng.randint(-1, 6))
    areas = [(k, k % 9, *box()) for k in range(80)]
    cuts = [(rng.randint(0, 8), *box()) for _ in range(60)]
    form = "top int, left int, bottom int, right int"
    got = subtracted(spark.createDataFrame(areas, f"a int, s int, {form}"), spark.createDataFrame(cuts, f"s int, {form}"), "a", "s").collect()
    cells = lambda t, x, b, r: set(itertools.product(range(t, b + 1), range(x, r + 1)))
    for a, s, *edges in areas:
        parts = [cells(r.top, r.left, r.bottom, r.right) for r in got if r.a == a]
        want = cells(*edges).difference(*[cells(*c) for k, *c in cuts if k == s])
        assert set().union(*parts) == want and sum(map(len, parts)) == len(want)


def test_recommended_scope(spark):
    rng = random.Random(9)
    nodes, limits = [], {"rows": 60, "cells": 80}
    for d in range(25):
        for k in range(rng.randint(1, 14)):
            parent = rng.choice([None, *range(k)]) if k else None
            nodes.append((d, k, parent if rng.random() > 0.03 else 99, rng.choice([None] * 6 + ["unknown"]), rng.choice([None, *range(0, 40, 5)]), rng.randint(0, 30)))
    nodes += [(50, 1, 2, None, 1, 1), (50, 2, 1, None, 1, 1), (50, 3, 2, None, 1, 1), (50, 4, None, None, 1, 1)]
    df = spark.createDataFrame(nodes, "d int, k int, p int, why string, rows int, cells int")
    got = {(r.d, r.node): (r.included, r.reason) for r in scopes.recommended(df, ["d"], "k", "p", "why", limits).collect()}
    for d in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == d}
        gone = {k: n[3] for k, n in own.items() if n[3]}

        def stays(k, own=own, gone=gone):
            seen = set()
            while k in own:
                if k in gone or k in seen:
                    return False
                seen.add(k)
                k = own[k][2]
            return True

        rest = [k for k in own if stays(k)]
        order = sorted(rest, key=lambda k: (-max((own[k][4] or 0) / 60, own[k][5] / 80), k))
        while rest and (sum(own[k][4] or 0 for k in rest) >= 60 or sum(own[k][5] for k in rest) >= 80):
            gone[next(k for k in order if k in rest)] = "aggregate_budget"
            rest = [k for k in rest if stays(k)]
        for k in own:
            assert got[d, k] == (k in rest, gone.get(k, "small" if k in rest else "ancestor_excluded")), (d, k)


def test_places_are_handed_on_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spans, "MOST_PLACES", 7)
    batch = pa.RecordBatch.from_pydict({"q": [1, 2, 3, 4], "t": ["ab cd " * 20, None, "", "cd"]})
    got = list(spans.located(iter([batch]), ["ab", "cd"], "q", "t"))
    assert max(b.num_rows for b in got) == 7
    rows = [r for b in got for r in zip(*[b.column(c).to_pylist() for c in ("q", "norm", "start")], strict=True)]
    assert rows == [(1, ("ab", "cd")[k % 2], 3 * k) for k in range(40)] + [(4, "cd", 0)]


def test_terms_past_the_last_one_are_noted_once(spark):
    known = spark.createDataFrame([(k, f, "phrase", True, True) for k in range(1, 9) for f in ([f"w{k}"] if k == 7 else [f"w{k}", f"x{k}", f"y{k}"])] + [(9, "w9", "phrase", True, False)], "term_id long, form string, mode string, can_trigger boolean, can_search boolean")
    asked = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(1, 10))), (2, " ".join(f"w{k}" for k in range(1, 7)) + " x6 y6")], "q long, t string")
    got = {r.q: [(s.term_id, s.reason) for s in r.skipped] for r in spans.plans(asked, known, "q", "t").collect()}
    assert got == {1: [(k, "max_terms_per_query") for k in (6, 8, 9)], 2: []}


def test_equal_areas_and_cuts_are_cut_once(spark, monkeypatch):
    from corpusmill.operators import areas as R

    monkeypatch.setattr(R, "BLOCK_ROWS", 3)
    form = "top int, left int, bottom int, right int"
    areas = [(k, None if k % 4 == 3 else k % 2, 0, 0, 9, 1) for k in range(40)]
    cuts = [(0, 2, 0, 7, 1)] * 30 + [(1, 4, 1, 20, 1)] * 30 + [(None, 0, 0, 9, 1)]
    got = subtracted(spark.createDataFrame(areas, f"a int, s int, {form}"), spark.createDataFrame(cuts, f"s int, {form}"), "a", "s").collect()
    left = {0: {(0, 0, 1, 1), (8, 0, 9, 1)}, 1: {(0, 0, 3, 1), (4, 0, 9, 0)}, None: {(0, 0, 9, 1)}}
    for a, s, *_ in areas:
        assert sorted(tuple(r)[1:] for r in got if r.a == a) == sorted(left[s])


def test_places_of_characters_agree_with_the_plain_way():
    rng = random.Random(12)
    some = ["ab", "Σ", "İ", "é", "é", " ", "  ", " \t\n", " ", "́", "Å", "क़", "ß", "-", ".", "_", "7", "/", "ǅ", "가", "가"]
    for k in range(600):
        text = "".join(rng.choice(some[: 5 if k % 3 == 0 else None]) for _ in range(rng.randint(0, 12)))
        low, starts, ends = spans.mapped(text)
        got, start, end = spans.placed(text)
        assert (got, [start(p) for p in range(len(got))], [end(p) for p in range(len(got))]) == (low, starts, ends), text


def test_places_that_are_no_phrase_stay_in_their_task():
    import pyarrow as pa

    forms = ["ab", "a-a", "ab cd", "x1"]
    batch = pa.RecordBatch.from_pydict({"q": [1, 2, 3], "t": ["cab abc  AB\tcd.ab", "ba-a-a a-a x1/ab -x1-", None]})
    rows = lambda once: sorted(r for b in spans.located(iter([batch]), forms, "q", "t", once) for r in zip(*[b.column(c).to_pylist() for c in b.schema.names], strict=True))
    want = [(1, "ab", 9, 11, "AB", True, True), (1, "ab", 15, 17, "ab", True, False), (1, "ab cd", 9, 14, "AB\tcd", True, False)]
    want += [(2, "a-a", 7, 10, "a-a", True, True), (2, "ab", 14, 16, "ab", True, False), (2, "x1", 11, 13, "x1", True, False), (2, "x1", 18, 20, "x1", True, True)]
    assert rows(False) == want and rows(True) == [r for k, r in enumerate(want) if r[:2] not in [w[:2] for w in want[:k]]]


def test_refusals_count_forms_and_terms_of_a_query_once(spark):
    known = spark.createDataFrame([(1, "Alpha"), (2, "alpha"), (2, "ALPHA"), (3, "beta"), (1, "beta"), (4, "lone")], "term_id long, form string").selectExpr("*", "'phrase' AS mode", "true AS can_trigger", "true AS can_search")
    known = spans.keyed(known)
    asked = spark.createDataFrame([(1, "alpha beta alpha"), (1, "Alpha lone"), (2, "lone"), (3, "beta")], "q int, t string")
    places = spans.occurrences(asked, spans.contested(known), "q", "t", once=True)
    assert sorted(map(tuple, spans.refusals(places, known, "q").collect())) == [(1, 2, 3), (3, 1, 2)]
    assert sorted(map(tuple, spans.refused(places, known, "q").where("q = 3").collect())) == [(3, 1, "beta"), (3, 3, "beta")]


def test_forms_of_plans_are_measured_once_for_all_queries(spark):
    forms = [(k, f, "phrase", True, True) for k in range(1, 8) for f in (f"w{k}", f"x{k}-y z{k}")] + [(1, "p " * 33 + "q", "phrase", False, True)]
    known = spark.createDataFrame(forms, "term_id long, form string, mode string, can_trigger boolean, can_search boolean")
    asked = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(1, 8))), (2, "w9"), (3, None)], "q long, t string")
    got = spans.plans(asked, known, "q", "t")
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.q: (r.status, r.added, [(s.term_id, s.reason) for s in r.skipped]) for r in got.collect()}
    assert rows[1] == ("limited", [f"x{k}-y z{k}" for k in range(1, 6)], [(1, "max_added_tokens"), (6, "max_terms_per_query"), (7, "max_terms_per_query")]) and rows[2] == ("no_match", [], []) == rows[3]
