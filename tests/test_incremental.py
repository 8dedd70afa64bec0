"""Signatures, outbox, resumed chunks and bootstrap intervals: what was done is not done again, and brute force agrees."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import resampling, retrieval, signatures
from corpusmill.operators.dedup import signatures as signed_at_once
from corpusmill.streaming import outbox


def test_signatures_grow_by_what_they_lack(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    docs = spark.createDataFrame([(i, text(i % 7)) for i in range(20)] + [(20, None), (21, ""), (22, f"  {text(3).upper()}  ")], "doc_id long, text string")
    first, n = signatures.grown(docs.where("doc_id < 5"), str(tmp_path))
    assert n == 5 and first.count() == 5
    both, n = signatures.grown(docs, str(tmp_path))
    assert n == 3
    want = {r.doc_id: (r.content_hash, r.sig) for r in signed_at_once(docs).collect()}
    assert {r.doc_id: (r.content_hash, r.sig) for r in both.collect()} == want
    again, n = signatures.grown(docs, str(tmp_path))
    assert n == 0 and again.count() == 23
    assert signatures.grown(docs.where("doc_id < 5"), str(tmp_path), 16)[1] == 5


def test_mail_identity(spark):
    rows = [("a", ["b", "c"], "s  t", "x\ny", ["2", "1", "1"]), ("a ", ["b", "c"], "s t", "x y", ["1", "2", "1"]), ("a", ["c", "b"], "s t", "x y", ["1", "2", "1"]), ("a", ["b", "c"], "s t", "x y", ["1", "2"]), (None, None, None, None, None), ("", [], "", "", [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, t array<string>, s string, b string, a array<string>")
    got = [r[0] for r in df.orderBy("i").select(signatures.mail_identity(*[F.col(c) for c in "ftsba"])).collect()]
    assert got[0] == got[1] and len(set(got)) == 4 and got[4] == got[5]


def test_outbox_survives_lost_batches(spark, tmp_path):
    source, folder, check = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    schema, now = "id long, at timestamp, body string", {"t": 100}
    rows = [(i, dt.datetime.fromtimestamp(i * 10), "bad" if i % 9 == 4 else f"b{i}") for i in range(30)] + [(None, dt.datetime.fromtimestamp(1), "x"), (3, dt.datetime.fromtimestamp(30), "b3")]
    write = outbox.dispatch(folder, "id", lambda: F.unix_seconds("at") <= now["t"], F.col("body") != "bad")
    fail = {"at": None}

    def shaky(batch, number):
        if fail["at"] == number:
            fail["at"] = None
            write(batch.limit(4), number)  # half of the work is done, and with fewer rows, when it dies
            raise RuntimeError("lost")
        write(batch, number)

    def play():
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(shaky)
        q.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(rows[:16], schema).coalesce(1).write.mode("append").parquet(source)
    fail["at"] = 0
    with pytest.raises(Exception, match="lost"):
        play()
    play()
    now["t"] = 1000
    spark.createDataFrame(rows[16:], schema).coalesce(1).write.mode("append").parquet(source)
    fail["at"] = 1
    with pytest.raises(Exception, match="lost"):
        play()
    play()
    sent = [r.id for r in spark.read.parquet(f"{folder}/sent").collect()]
    assert sorted(sent) == sorted(i for i in range(30) if i % 9 != 4)
    assert {r.batch for r in spark.read.parquet(f"{folder}/sent").where("id > 10 AND id < 16").collect()} == {1}
    assert sorted((r.id is None, r.id) for r in spark.read.parquet(f"{folder}/dead").collect()) == [(False, 4), (False, 13), (False, 22), (True, None)]
    assert spark.read.parquet(f"{folder}/held/batch=1").count() == 0


def test_chunks_resume(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 4) for i in range(20)], "id long, part int")
    seen = []

    def work(left):
        seen.append(left.count())
        return left.withColumn("twice", F.col("id") * 2).select("id", "twice", "part")

    folder = str(tmp_path / "done")
    outbox.resumed(rows.where("part < 2"), folder, "id", "part", work)
    got = outbox.resumed(rows, folder, "id", "part", work)
    assert seen == [10, 10] and sorted((r.id, r.twice, r.part) for r in got.collect()) == [(i, 2 * i, i % 4) for i in range(20)]
    assert outbox.resumed(rows, folder, "id", "part", work).count() == 20 and seen[-1] == 0


def test_bootstrap_by_the_same_weights(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.random() * 100 if i % 11 else None) for i in range(300)] + [("c", 999, 5.0), ("d", 998, None)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(3)
    got = {r.g: (r.mean, r.low, r.high) for r in resampling.bootstrap_mean(df, ["g"], "i", "x", replicates=50, level=0.9).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"][0] == got["c"][1] == got["c"][2] == 5.0

    def weight(i, rep):
        u = int(hashlib.md5(f"7:{i}:{rep // 4}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16) / 2**32
        n, p, total = 0, math.exp(-1), math.exp(-1)
        while u >= total and n < 9:
            n += 1
            p /= n
            total += p
        return n

    for g in "ab":
        own = [(i, x) for k, i, x in rows if k == g and x is not None]
        means = sorted(sum(weight(i, r) * x for i, x in own) / sum(weight(i, r) for i, _ in own) for r in range(50))
        assert got[g] == pytest.approx((sum(x for _, x in own) / len(own), means[2], means[47]))
        assert got[g][1] < got[g][0] < got[g][2]


def test_bm25_by_blocks_and_by_joins(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "and", "zeta"]) + str(rng.randrange(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(30))) for i in range(150)] + [(None, text(5)), (200, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(4)) for i in range(12)] + [(50, ""), (51, None)], "item_id long, text string")
    blocks = sorted(map(tuple, retrieval.bm25(docs.where("doc_id IS NOT NULL"), asked, top=7).collect()))
    monkeypatch.setattr(retrieval, "PASS_NUMBERS", 100)
    assert sorted(map(tuple, retrieval.bm25(docs.where("doc_id IS NOT NULL"), asked, top=7).collect())) == blocks
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 3)
    joined = sorted(map(tuple, retrieval.bm25(docs.where("doc_id IS NOT NULL"), asked, top=7).select(*retrieval.bm25(docs, asked).columns).collect()))
    assert joined == blocks and len(blocks) == 12 * 7
    monkeypatch.undo()
    assert retrieval.bm25(docs.where("false"), asked).collect() == [] == retrieval.bm25(docs, asked.where("false")).collect()
