"""Capacity slots against a plain replay of the commands, with a restart in between."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest

from corpusmill.streaming.capacity import COMMANDS, capacity

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, was)


def row(resource, seconds, command, owner, slot=None, fence=None, ttl=None, hold=None, required=False):
    return (resource, dt.datetime.fromtimestamp(seconds, dt.timezone.utc).replace(tzinfo=None), seconds, command, owner, slot, fence, ttl, hold, required)


def replay(rows, limit):
    slots, out = {}, []
    for r in rows:
        resource, _, now, command, owner, slot, fence, ttl, hold, required = r
        own = slots.setdefault(resource, {})
        busy = lambda s, now=now: s["owner"] is not None and (s["required"] or s["expires"] > now or s["protected"] > now)
        if command == "reserve":
            free = next((k for k in range(limit) if k not in own or not busy(own[k])), None)
            if free is None:
                out.append((resource, now, command, owner, None, None, "full"))
                continue
            own[free] = {"owner": owner, "fence": own.get(free, {"fence": 0})["fence"] + 1, "expires": now + ttl, "protected": now + (hold or ttl), "required": required}
            out.append((resource, now, command, owner, free, own[free]["fence"], "reserved"))
            continue
        s = own.get(slot)
        mine = s is not None and s["owner"] == owner and s["fence"] == fence
        live = mine and s["expires"] > now
        if command == "renew" and live:
            s["expires"], said = now + ttl, "renewed"
            s["protected"] = max(s["protected"], s["expires"])
        elif command == "release" and live and not s["required"] or command == "complete" and mine and s["required"]:
            s["owner"], said = None, f"{command}d"
            s["required"] = False
        else:
            said = "lost"
        out.append((resource, now, command, owner, slot, fence, said))
    return out


def test_slots_with_restart(rocks, tmp_path):
    rng, now = random.Random(4), 1_700_000_000
    rows = [row("c", now, "reserve", "early", ttl=10, hold=20), row("c", now, "reserve", "kept", ttl=10, required=True)]
    for k in range(240):
        now += rng.randint(1, 9)
        resource, owner = rng.choice("ab"), f"o{rng.randint(0, 3)}"
        if rng.random() < 0.5:
            ttl = rng.randint(5, 30)
            rows.append(row(resource, now, "reserve", owner, ttl=ttl, hold=ttl + rng.choice([0, 0, 20]), required=rng.random() < 0.2))
        else:
            leases = [x for x in replay(rows, 3) if x[6] == "reserved"][-4:]
            resource, _, _, owner, slot, fence, _ = rng.choice(leases)
            rows.append(row(resource, now, rng.choice(["renew", "release", "complete"]), owner, slot, fence - (rng.random() < 0.2), ttl=10))
    source, sink, check = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    for part in (rows[:120], rows[120:]):
        rocks.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        q = capacity(rocks.readStream.schema(COMMANDS).parquet(source), 3).writeStream.format("parquet").outputMode("append")
        q.option("checkpointLocation", check).trigger(availableNow=True).start(sink).awaitTermination()
    got = rocks.read.parquet(sink)
    answered = sorted(tuple(r) for r in got.where("command <> 'timer'").collect())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, answered), key=key) == sorted(replay(rows, 3), key=key)
    timed = got.where("command = 'timer'").collect()
    assert [(r.resource, r.owner, r.slot, r.seconds, r.status) for r in timed if r.resource == "c"] == [("c", "early", 0, 1_700_000_020, "expired")]
    said = {s for *_, s in map(tuple, answered)}
    assert {"reserved", "full", "renewed", "released", "completed", "lost"} <= said
