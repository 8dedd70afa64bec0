"""Streams give what their batch twins give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import events as batch
from corpusmill.streaming import events as stream

SF = "/root/testdata/sf0.001"


def played(spark, tmp_path, df, program, mode="append"):
    """The stream's result over df, written as one file and read as a stream."""
    source, name = str(tmp_path / uuid.uuid4().hex), f"t{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(source)
    q = program(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName(name).outputMode(mode)
    q = q.option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def test_limits(spark, tmp_path):
    rows = events(spark).select("event_id", "user_id", F.unix_seconds("ts").alias("s"))
    got = played(spark, tmp_path, rows, lambda s: stream.rate_limited(s, "user_id", "s", "event_id", 2, 86400 * 3))
    want = batch.admitted(rows, "user_id", "s", "event_id", 2, 86400 * 3)
    assert {(r.event_id, r.admitted) for r in got.collect()} == {(r.event_id, r.admitted) for r in want.collect()}


def test_windows(spark, tmp_path):
    got = played(spark, tmp_path, events(spark), lambda s: stream.tumbling(s, "ts", "1 day", "1 hour", ["event_type"]))
    want = events(spark).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    closed, every = {tuple(r) for r in got.collect()}, {tuple(r) for r in want.collect()}
    assert closed <= every and len(closed) > 0.9 * len(every)


def test_duplicates(spark, tmp_path):
    doubled = events(spark).unionByName(events(spark).limit(100))
    assert played(spark, tmp_path, doubled, lambda s: stream.first_only(s, "ts", "40 days", ["event_id"])).count() == events(spark).count()


def test_leases(spark, tmp_path):
    steps = [(0, "enqueue", 0), (1, "claim", 0), (2, "claim", 0), (5, "renew", 1), (14, "finish", 9), (20, "claim", 0), (21, "finish", 1), (22, "finish", 2), (23, "claim", 0)]
    df = spark.createDataFrame([(7, s, c, f) for s, c, f in steps], "work_id long, seconds long, command string, fence long")
    got = played(spark, tmp_path, df, lambda s: stream.leases(s, 10)).orderBy("seconds").collect()
    assert [r.status for r in got] == ["queued", "claimed", "refused", "renewed", "refused", "claimed", "refused", "done", "refused"]
