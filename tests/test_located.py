"""Verified fragments, places of results, purging and clones on small tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corpusmill.operators import located
from corpusmill.session import settled
from corpusmill.sources import sinks

TEXTS = [(1, "abcdefghij" * 3), (2, "é" * 21), (3, ""), (4, None), (5, "abcdefghij"), (6, "to change"), (7, "to go")]


def test_tampered_fragments_fall_back(spark):
    chunks = spark.createDataFrame(TEXTS, "doc int, text string")
    index, contents = (x.cache() for x in located.indexed(chunks, ["doc"], "text", 10))
    assert contents.count() == contents.select("hash").distinct().count()
    assert {r.doc for r in located.verified(index, contents, ["doc"]).where("whole").collect()} == {1, 2, 3, 4, 5, 6, 7}
    now = chunks.where("doc <> 7").withColumn("text", F.when(F.col("doc") == 6, "changed").otherwise(F.col("text")))
    hits = index.select("doc", "ordinal").unionByName(spark.createDataFrame([(1, 99)], "doc int, ordinal long"))

    def shown(index, contents):
        got = located.hydrated(hits, index, contents, now, ["doc"], "text").collect()
        assert len(got) == hits.count()
        return {(r.doc, r.ordinal): (r.basis, r.shown) for r in got}

    got = shown(index, contents)
    assert got[1, 0] == ("fragment", "abcdefghij") and got[1, 99] == ("chunk", "abcdefghij" * 3) and got[6, 0] == ("chunk", "changed") and got[7, 0] == ("gone", None)
    assert "".join(got[2, k][1] for k in range(sum(d == 2 for d, _ in got))) == "é" * 21 and got[3, 0] == got[4, 0] == ("fragment", "")
    bad = contents.withColumn("fragment", F.when(F.col("fragment") == "abcdefghij", "ABCDEFGHIJ").otherwise(F.col("fragment")))
    got = shown(index, bad)
    assert got[1, 0] == ("chunk", "abcdefghij" * 3) and got[5, 0] == ("chunk", "abcdefghij") and got[2, 0][0] == "fragment"
    for broken in (index.where("NOT (doc = 2 AND ordinal = 0)"), index.withColumn("ordinal", F.when(F.col("doc") == 2, F.col("ordinal") + 1).otherwise(F.col("ordinal")))):
        assert not located.verified(broken, contents, ["doc"]).where("doc = 2").first().whole
    assert shown(index.where("false"), contents)[1, 0][0] == "chunk"


def test_places_of_results(spark):
    chunks = spark.createDataFrame([(1, 0, "one two  three two"), (2, 0, "same text"), (3, 0, "stays here"), (5, 0, "lost later")], "doc int, n int, text string")
    active = spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g1"), (5, "g1")], "doc int, generation string")
    hits = spark.createDataFrame([(1, 0, "g1", "two three"), (1, 0, "g1", "two"), (2, 0, "g1", "same"), (3, 0, "g1", "stays"), (4, 0, "g1", "x"), (5, 0, "g1", "lost"), (3, 0, None, "stays")], "doc int, n int, generation string, excerpt string")
    refs = located.references(hits, chunks, active, ["doc", "n"], "doc", "text", "excerpt").cache()
    seen = {(r.doc, r.generation, r.excerpt): (r.basis, [tuple(s) for s in r.spans]) for r in refs.collect()}
    assert seen == {
        (1, "g1", "two three"): ("match", [(4, 14)]), (1, "g1", "two"): ("chunk", []), (2, "g1", "same"): ("chunk", []), (3, "g1", "stays"): ("match", [(0, 5)]), (4, "g1", "x"): (None, []),
        (5, "g1", "lost"): ("match", [(0, 4)]), (3, None, "stays"): ("chunk", []),
    }
    later = spark.createDataFrame([(1, 0, "one two  three two!"), (3, 0, "stays here")], "doc int, n int, text string")
    got = located.resolved(refs.where("generation IS NOT NULL"), later, active, ["doc", "n"], "doc", "text").collect()
    assert {(r.doc, r.excerpt): (r.basis, len(r.spans)) for r in got} == {(1, "two three"): ("chunk", 0), (1, "two"): ("chunk", 0), (2, "same"): ("gone", 0), (3, "stays"): ("match", 1), (4, "x"): ("gone", 0), (5, "lost"): ("gone", 0)}


def test_purge_and_clone(spark):
    rows = spark.createDataFrame([(1, "d"), (2, None), (3, "d"), (None, "d")], "id int, deleted string")
    doomed = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "id int")
    assert sorted((r.id is None, r.id) for r in sinks.purged(rows, doomed, "id", "deleted").collect()) == [(False, 2), (False, 3), (True, None)]
    table = spark.createDataFrame([(1, "a", "g1"), (2, None, "g1"), (3, "b", "g1"), (4, "a", "g0")], "id int, source string, generation string")
    chosen = spark.createDataFrame([("a",), ("a",), (None,)], "source string")
    once = sinks.cloned(table, "g1", "g2", "source", chosen)
    assert sorted(r.id for r in once.where("generation = 'g2'").collect()) == [1, 2] and once.count() == 6
    assert sinks.cloned(once, "g1", "g2", "source", chosen).count() == 6


def shuffled(spark, rows) -> int:
    """Bytes that working out these rows shuffles."""
    sc = spark.sparkContext
    none, some = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(some(), False, False, none, some())
        return {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    rows.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


def test_texts_move_once_whatever_the_number_of_hits(spark):
    text = "".join(hashlib.sha512(str(k).encode()).hexdigest() for k in range(3000))
    chunks = spark.createDataFrame([(1, text), (2, text[::-1])], "doc int, text string")
    index, contents = (settled(x) for x in located.indexed(chunks, ["doc"], "text", 1000))
    now = settled(chunks.withColumn("text", F.when(F.col("doc") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    shown = located.hydrated(index.select("doc", "ordinal"), index, contents, now, ["doc"], "text")
    assert shuffled(spark, shown.select("doc", "basis", F.length("shown"))) < 3 * len(text)
    assert {(r.doc, r.basis): r["count"] for r in shown.groupBy("doc", "basis").count().collect()} == {(1, "fragment"): 384, (2, "chunk"): 384}
    whole = shown.where("doc = 1").orderBy("ordinal").collect()
    assert "".join(r.shown for r in whole) == text
