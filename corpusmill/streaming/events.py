"""Streams of events: windows, duplicates, limits and leases. Batch twins are in operators.events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts of closed windows; events later than ``late`` are dropped."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, seconds: str, order: str, limit: int, window: int) -> DataFrame:
    """(key, order, admitted): state holds the times of admitted events that still count, at most ``limit`` of them."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([seconds, order], kind="stable")
        admitted = []
        for t in rows[seconds]:
            passed = [x for x in passed if t - x < window]
            admitted.append(len(passed) < limit)
            if admitted[-1]:
                passed.append(int(t))
        state.update((passed,))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "admitted": admitted})

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean"
    return events.groupBy(key).applyInPandasWithState(step, schema, "passed array<long>", "append", GroupStateTimeout.NoTimeout)


def leases(commands: DataFrame, lease: int) -> DataFrame:
    """(work_id, seconds, command, fence, status): claims, renewals and ends of work items under a lease.

    A claim succeeds on a queued item or an expired lease and raises the fence; a renewal or an end needs the current
    fence and a live lease. commands: (work_id, seconds, command, fence), command in enqueue, claim, renew, finish.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, fence, until = state.get if state.exists else ("none", 0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("seconds", kind="stable").itertuples():
            live = status == "running" and row.seconds < until
            if row.command == "enqueue" and status == "none":
                status, said = "queued", "queued"
            elif row.command == "claim" and (status == "queued" or status == "running" and not live):
                status, fence, until, said = "running", fence + 1, row.seconds + lease, "claimed"
            elif row.command == "renew" and live and row.fence == fence:
                until, said = row.seconds + lease, "renewed"
            elif row.command == "finish" and live and row.fence == fence:
                status, said = "done", "done"
            else:
                said = "refused"
            out.append((k[0], row.seconds, row.command, fence, said))
        state.update((status, fence, until))
        yield pd.DataFrame(out, columns=["work_id", "seconds", "command", "fence", "status"])

    schema = "work_id long, seconds long, command string, fence long, status string"
    return commands.groupBy("work_id").applyInPandasWithState(step, schema, "status string, fence long, until long", "append", GroupStateTimeout.NoTimeout)
