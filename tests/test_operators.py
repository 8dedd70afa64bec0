"""Operators on chosen tables."""

from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import catalogue, chunks, dedup, events, glossary, retrieval
from corpusmill.sources import sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_fusion_adds_up_branches(spark):
    a = spark.createDataFrame([("q", "x", 0), ("q", "y", 1)], "q string, k string, rank int")
    b = spark.createDataFrame([("q", "y", 0)], "q string, k string, rank int")
    got = {r.k: r.score for r in retrieval.fuse({"dense": a, "bm25": b}, "q", "k").collect()}
    assert got["x"] == pytest.approx(1 / 60, abs=1e-9) and got["y"] == pytest.approx(1 / 61 + 1.5 / 60, abs=1e-9)


def test_budget_keeps_the_block_that_crosses(spark):
    df = spark.createDataFrame([("g", i, 40) for i in range(5)], "g string, i int, n int")
    assert rows(retrieval.budget(df, "g", [F.col("i")], F.col("n"), 100), "i") == [(0,), (1,), (2,)]


def test_expansion_ranks_by_id(spark):
    hits = spark.createDataFrame([("q", 1)], "q string, node long")
    edges = spark.createDataFrame([(1, 9), (1, 3), (1, 1), (2, 5)], "node long, other long")
    got = retrieval.expand(hits, edges, "node", "other", "q")
    assert rows(got, "node", "score", "rank") == [(3, 0.5, 100), (9, 0.5, 101)]


def test_unmatched_hits_go_only_if_some_match(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False)], "g string, i int, m boolean")
    assert rows(retrieval.drop_unmatched(df, "g", F.col("m")), "i") == [(1,), (3,)]


def test_ancestry_leaves_cycles_out(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")], "node string, parent string")
    assert rows(catalogue.ancestry(edges), "node", "depth") == [("a", 1), ("b", 2), ("r", 0), ("x", None), ("y", None)]


@pytest.mark.parametrize("length", [32, 33, 40])
def test_paths_have_at_most_32_nodes(spark, length):
    edges = spark.createDataFrame([(k, k - 1 if k else None) for k in range(length)], "node int, parent int")
    got = {r.node: (r.root, r.depth, r.path) for r in catalogue.ancestry(edges).collect()}
    assert got == {k: (0, k, list(range(k + 1))) if k < 32 else (None, None, []) for k in range(length)}


def test_best_match_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randint(1, 9)))
    known, asked = {name() for _ in range(60)}, {name() for _ in range(50)}
    want = {}
    for a in asked:
        found = [(SequenceMatcher(None, b.lower(), a.lower()).ratio(), b) for b in sorted(known)]
        best = max(r for r, _ in found)
        if best >= 0.7:
            want[a] = (round(best, 6), min(b for r, b in found if r >= best - 1e-12))
    left, right = (spark.createDataFrame([(x,) for x in xs] + [(None,)], f"{c} string") for xs, c in ((asked, "a"), (known, "b")))
    for size in (1000, 7):
        monkeypatch.setattr(catalogue, "PASS_NAMES", size)
        assert {r.a: (r.likeness, r.b) for r in catalogue.best_match(left, right, "a", "b", 0.7).collect()} == want


@pytest.mark.parametrize("numbers", [1 << 22, 40])
def test_dense_against_brute_force(spark, monkeypatch, numbers):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(retrieval, "PASS_NUMBERS", numbers)
    points = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    table = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in retrieval.dense(table, table.where("vec_id % 3 = 0"), top=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want: dict = {}
    real = [(i, np.array(v)) for i, v in points if v and any(v)]
    for q, x in real:
        if q % 3 == 0:
            scored = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), i) for i, y in real if i != q)
            want[q] = [(i, -s) for s, i in scored[:5]]
    assert got.keys() == want.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_dense_holds_few_products_at_once(monkeypatch):
    import pyarrow as pa

    made = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            made.append(len(self) * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(retrieval, "PASS_CELLS", 64)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (50, 4)).astype(float)
    x[:, 0] += 0.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    class Sent:
        value = (pa.array(range(0, 50, 5)), unit[::5].view(Watched))

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["k", "v"])
    got = pa.Table.from_batches(retrieval._best_of(Sent, "k", 7, True)([batch.slice(0, 31), batch.slice(31)])).to_pylist()
    want = []
    for q in range(0, 50, 5):
        scored = sorted((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i in range(50) if i != q)
        want += [(q, i, round(-s, 6)) for s, i in scored[:7]]
    assert sorted((r["query_id"], r["k"], round(r["score"], 6)) for r in got) == sorted(want)
    assert max(made) <= 64


def test_signatures_come_in_small_batches_and_are_right():
    import pyarrow as pa

    bases = [[], [0], [7, (1 << 28) - 1], list(range(1, 3000, 7)), list(range((1 << 28) - 600, 1 << 28)), []] * 400
    n = len(bases)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["h"] * n), pa.array(bases, pa.list_(pa.int64()))], names=["doc_id", "content_hash", "base"])
    out = list(dedup._signed(8)([batch]))
    assert max(b.num_rows for b in out) <= dedup.BATCH < n
    got = [s for b in out for s in b.column("sig").to_pylist()]
    want = [[min((dedup.slope(i) * x + dedup.shift(i)) % dedup.PRIME for x in base) for i in range(8)] if base else [] for base in bases[:6]]
    assert got == want * 400


def test_locales(spark):
    df = spark.createDataFrame([("en",), ("de",), (None,)], "l string")
    assert catalogue.in_locales(F.col("l"), [], False) is None
    assert rows(df.where(catalogue.in_locales(F.col("l"), ["en"], True)), "l") == [("en",), (None,)]
    assert rows(df.where(catalogue.in_locales(F.col("l"), [], True)), "l") == [(None,)]


def test_limits_count_admitted_events_only(spark):
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate([0, 1, 2, 10, 11, 12])], "k string, s long, i long")
    got = events.admitted(df, "k", "s", "i", 2, 10).orderBy("i").collect()
    assert [r.admitted for r in got] == [True, True, False, True, True, False]


def test_merged_spans(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 8), ("k", 9, 10)], "k string, s long, e long")
    assert rows(events.merged_spans(df, "k", "s", "e"), "s", "e") == [(0, 8), (9, 10)]


def test_chunks_join_to_the_text():
    text = "\n\n".join(f"para {i} " + "x" * (i % 7) * 10 for i in range(50)) + "\n\n```\ncode\n\nmore\n```\n\nend"
    got = chunks.pack(text, 200)
    assert "\n\n".join(got) == text and all(len(c) <= 200 for c in got)
    assert sum("```\ncode\n\nmore\n```" in c for c in got) == 1
    for t in ("é" * 3000, "ab\n" * 2000, "", "x" * 2000):
        pieces = chunks.cut(t, 2000)
        assert "".join(pieces) == t and all(len(p.encode()) <= 2000 for p in pieces)


def test_pipe_tables():
    text = "intro\n| a | b |\n|---|:-:|\n| 1 | x\\|y |\n| 2 | long\ncell |\n\n| no | rule |\n| 1 | 2 |"
    assert list(chunks.pipe_tables(text)) == [(1, 6, ["a", "b"], [["1", "x|y"], ["2", "long\ncell"]])]


def test_titles_and_quotes(spark):
    df = spark.createDataFrame([("# One\ntext\n## Two \nmore", "text", "e")], "t string, q string, r string")
    got = df.select(chunks.section_title(F.col("t")).alias("a"), chunks.quote_span(F.col("t"), F.col("q")).alias("b"), chunks.quote_span(F.col("t"), F.col("r")).alias("c")).first()
    assert got.a == "Two" and tuple(got.b) == (6, 10) and got.c is None


def test_glossary(spark):
    terms = spark.createDataFrame([(1, "personnel area"), (2, "area"), (3, "Cost Center")], "term_id long, name string")
    aliases = spark.createDataFrame([(3, "cc", True, True), (3, "kostenstelle", False, True)], "term_id long, alias string, can_search boolean, can_expand boolean")
    known = glossary.forms(terms, aliases)
    asked = spark.createDataFrame([(1, "Which personnel area has cc?"), (2, "kostenstelle area"), (3, "none")], "q long, t string")
    found = glossary.mentions(asked, known, "q", "t")
    assert rows(found, "q", "term_id", "form") == [(1, 1, "personnel area"), (1, 3, "cc"), (2, 2, "area")]
    assert rows(glossary.expansions(found, known, "q"), "q", "added") == [(1, "cost center"), (1, "kostenstelle")]
    assert rows(glossary.clashes(known), "a", "b") == []


def test_glossary_finds_long_forms(spark):
    long = "one two three four five six seven"
    terms = spark.createDataFrame([(1, long), (2, "three four")], "term_id long, name string")
    none = spark.createDataFrame([], "term_id long, alias string, can_search boolean, can_expand boolean")
    asked = spark.createDataFrame([(1, f"zero {long} eight"), (2, "two three four"), (3, "")], "q long, t string")
    found = glossary.mentions(asked, glossary.forms(terms, none), "q", "t")
    assert rows(found, "q", "term_id", "start", "size") == [(1, 1, 2, 7), (2, 2, 2, 2)]
    assert glossary.mentions(asked, glossary.forms(terms.limit(0), none), "q", "t").count() == 0


def test_every_duplicate_has_a_class(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (2, text), (3, f"{text}!"), (4, "eight"), (5, ""), (6, None)], "doc_id long, text string")
    signed = dedup.signatures(docs)
    assert rows(dedup.members(signed, dedup.classes(signed)).where("class_id IS NOT NULL"), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert rows(dedup.exact_members(docs), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(sinks.upserted(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.insert_missing(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(sinks.changed(old, new, "k", ["v"]), "k", "v") == [(2, "c")]
    sinks.replace_partitions(old, str(tmp_path / "t"), "k")
    sinks.replace_partitions(new, str(tmp_path / "t"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    pointers = spark.createDataFrame([(7, "g1", "active"), (7, "g2", "ready"), (8, "g1", "active")], "doc_id int, generation string, status string")
    assert rows(sinks.publish(pointers, 7, "g2", "g1"), "doc_id", "generation", "status") == [(7, "g1", "retired"), (7, "g2", "active"), (8, "g1", "active")]
    with pytest.raises(ValueError):
        sinks.publish(pointers, 7, "g2", "g0")
    parts = sinks.with_parts(spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 1, 20, 2])], "g string, i int, n int"), "g", "i", "n", 10)
    assert rows(parts, "i", "part") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


ODD_TEXTS = ["", None, "one", "a b c d", "И в Straße İstanbul ΟΔΟΣ ёлка naïve ﬀ x1", "one two three four five six one two three four five " * 90, "a-b_c\tд̇ \U0001d400bc Ž", " \n"]


def test_words_and_slots_in_tasks_are_those_of_columns(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string")
    seen = rows.select(T.for_tokens(F.col("text")).alias("t"), T.all_tokens(F.col("text")).alias("w"), F.transform(T.all_tokens(F.col("text")), T.slot).alias("s")).collect()
    assert all(T.words(r.t) == r.w and [T.slot_of(w) for w in r.w] == r.s for r in seen)
    known = T.Numbers(len)
    known.MOST = 2
    assert known.of(["a", "bb", "ccc", "a"]).tolist() == [1, 2, 3, 1] and len(known) <= 2


def test_postings_and_signatures_leave_the_words_to_tasks(spark):
    docs = spark.createDataFrame([*enumerate(ODD_TEXTS), (1, "one more"), (None, "no id")], "doc_id long, text string")
    slots = docs.select("doc_id", F.explode(F.transform(T.tokens(F.col("text")), T.slot)).alias("slot")).groupBy("doc_id", "slot").count()
    got = retrieval.postings(docs, "doc_id", "text")
    assert sorted((str(r.doc_id), r.slot, round(r.weight, 9)) for r in got.collect()) == sorted((str(r.doc_id), r.slot, round(math.log1p(r["count"]), 9)) for r in slots.collect())
    base = F.transform(dedup.shingles(F.col("text")), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 7), 16, 10).cast("long"))
    want = [[min((x * dedup.slope(i) + dedup.shift(i)) % dedup.PRIME for x in r.b) for i in range(dedup.SLOTS)] if r.b else [] for r in docs.select(base.alias("b")).collect()]
    signed = dedup.signatures(docs)
    assert [r.sig for r in signed.collect()] == want
    for df in (got, signed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "md5" not in plan
