"""Knowledge operators on chosen rows."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.operators import chunks as C
from corpusmill.operators import knowledge as K


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_stems(spark):
    for word, want in (("сотрудниками", "сотрудник"), ("отпуска", "отпуск"), ("дома", "дома"), ("таблица", "таблиц"), ("табельного", "табельн"), ("табельных", "табельн"), ("номеров", "номер"), ("plans", "plans")):
        assert one(spark, K.stem(F.col("w")), w=word) == want
    assert one(spark, K.mentions(F.col("t"), F.array(F.lit("отпуска"), F.lit("табель"))), t="про отпуск") == ["отпуска"]


def test_uuid5(spark):
    for name in ("doc:1", "Ä", ""):
        assert one(spark, K.uuid5(str(uuid.NAMESPACE_URL), F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_citations(spark):
    assert one(spark, K.citations(F.col("t")), t="Block with ID 3, source [4] [4] and id 5") == "[3], [4] and id 5"


def test_maps_and_states(spark):
    assert one(spark, K.set_entry(F.create_map(F.lit("a"), F.lit(1)), "a", F.lit(2)), t=1) == {"a": 2}
    got = [one(spark, C.cell_state(F.col("v"), F.col("f")), v=v, f=f) for v, f in (("1", "x"), ("", "x"), ("#REF!", "x"))]
    assert got == ["value", "empty", "error"]


def test_slugs_stay_unique(spark):
    rows = spark.createDataFrame([("d", "x", 1), ("d", "x", 2), ("e", "x", 3)], "doc string, slug string, i int")
    assert [r.slug for r in K.unique_slugs(rows, "doc", "slug", "i").orderBy("i").collect()] == ["x", "x-1", "x"]
    for bases, want in ((["x", "x", "x-1"], ["x", "x-1", "x-1-1"]), (["x-1", "x", "x", "y", "y"], ["x-1", "x", "x-2", "y", "y-1"])):
        rows = spark.createDataFrame([("d", b, k) for k, b in enumerate(bases)], "doc string, slug string, i int")
        assert [r.slug for r in K.unique_slugs(rows, "doc", "slug", "i").orderBy("i").collect()] == want


def test_slugs_against_brute_force(spark):
    parts = ["a", "a-1", "a-2", "a-1-1", "a-01", "a-0", "-1", "", "b", "a-", "a--1", None]
    rng = random.Random(3)
    rows = [(g, rng.choice(parts), k) for k, g in enumerate(rng.choices(["d", "e", None], k=600))]
    want, used = {}, {}
    for g, base, k in rows:
        seen, name, n = used.setdefault(g, set()), base, 1
        while base is not None and name in seen:
            name, n = f"{base}-{n}", n + 1
        seen.add(name)
        want[k] = name
    df = spark.createDataFrame(rows, "doc string, slug string, i int")
    assert {r.i: r.slug for r in K.unique_slugs(df.repartition(5), "doc", "slug", "i").collect()} == want
    assert K.unique_slugs(df.limit(0), "doc", "slug", "i").count() == 0


def test_trees(spark):
    edges = spark.createDataFrame([(1, "r", None, True), (1, "a", "r", None), (1, "b", "zz", False)], "g int, node string, parent string, flag boolean")
    assert tuple(K.tree_faults(edges, "g", "node", "parent").first()) == (1, 3, 0, 1, 1)
    assert {(r.node, r.inherited) for r in K.inherited(edges, "node", "parent", "flag").collect()} == {("r", True), ("a", True)}


def test_vectors(spark):
    v = one(spark, K.test_vector(F.col("t")), t="alpha beta beta")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and one(spark, K.test_vector(F.col("t")), t="") == [0.0] * 16


def test_regions(spark):
    cells = spark.createDataFrame([("s", 1, c) for c in (1, 2, 3, 6, 7)], "sheet string, row int, col int")
    assert sorted((r["first"], r["last"]) for r in C.regions(cells).collect()) == [(1, 3), (6, 7)]


def test_vectors_of_tasks_are_those_of_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None), (4, "Straße ёлка x İs"), (None, "z")], "id int, text string")
    want = [(r.id, r.v) for r in docs.select("id", K.test_vector(F.col("text")).alias("v")).collect()]
    assert [(r.id, r.embedding) for r in K.test_vectors(docs, "id", "text").collect()] == want


def test_faults_of_odd_trees_and_shares_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 2)
    edges = [("a", 1, None), ("a", 2, 1), ("a", 2, 1), ("a", 3, 9), ("b", None, 7), ("b", 7, None), ("b", 8, None), (None, 1, None), (None, 2, 1), ("c", 5, 5)]
    got = K.tree_faults(spark.createDataFrame(edges, "g string, n int, p int"), "g", "n", "p")
    assert {r.g: (r.nodes, r.repeated, r.roots, r.strays) for r in got.collect()} == {"a": (4, 1, 1, 1), "b": (3, 1, 2, 0), None: (2, 0, 1, 1), "c": (1, 0, 0, 0)}
    assert got.rdd.getNumPartitions() == 10
    cells = [(1, 1, c) for c in (1, 2, 2, 3, 5)] + [(1, 2, 4), (2, 1, 1), (2, 1, 1)]
    runs = C.regions(spark.createDataFrame(cells, "sheet int, row int, col int"))
    assert sorted(map(tuple, runs.select("sheet", "row", "first", "last").collect())) == [(1, 1, 1, 3), (1, 1, 5, 5), (1, 2, 4, 4), (2, 1, 1, 1)]
    assert runs.rdd.getNumPartitions() == 4
