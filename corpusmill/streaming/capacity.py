"""Capacity slots of resources as state of a stream: leases with an end, a protected time, and fences.

Each resource has ``limit`` slots. A slot is busy while its lease has not ended, while it is protected, or until its work is said to be
complete where that is asked for. Timers of the stream's own time give slots back, so state holds busy slots and the last fence of each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Commands: reserve (ttl, hold, required), renew (ttl), release, complete; times in seconds, slots from 0.
COMMANDS = "resource string, at timestamp, seconds long, command string, owner string, slot int, fence long, ttl long, hold long, required boolean"
ANSWERS = "resource string, seconds long, command string, owner string, slot int, fence long, status string"
_SLOT = "owner string, fence long, expires long, protected long, required boolean"


class Slots(StatefulProcessor):
    """Answers each command of a resource in order of its seconds."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", _SLOT)

    def _busy(self, slot: int, now: int) -> bool:
        if not self.slots.containsKey((slot,)):
            return False
        owner, _, expires, protected, required = self.slots.getValue((slot,))
        return owner is not None and (required or expires > now or protected > now)

    def _owned(self, r: Row) -> tuple | None:
        """The slot's state if it is this owner's under this fence."""
        if r.slot is None or not self.slots.containsKey((r.slot,)):
            return None
        held = self.slots.getValue((r.slot,))
        return held if held[0] is not None and held[0] == r.owner and held[1] == r.fence else None

    def _reserve(self, r: Row) -> tuple[str, int | None, int | None]:
        hold = r.ttl if r.hold is None else r.hold
        if not r.owner or r.ttl is None or r.ttl <= 0 or hold < r.ttl:
            return "invalid", None, None
        slot = next((k for k in range(self.limit) if not self._busy(k, r.seconds)), None)
        if slot is None:
            return "full", None, None
        fence = 1 + (self.slots.getValue((slot,))[1] if self.slots.containsKey((slot,)) else 0)
        self.slots.updateValue((slot,), (r.owner, fence, r.seconds + r.ttl, r.seconds + hold, bool(r.required)))
        self.handle.registerTimer((r.seconds + hold) * 1000)
        return "reserved", slot, fence

    def _answer(self, r: Row) -> tuple[str, int | None, int | None]:
        if r.command == "reserve":
            return self._reserve(r)
        held = self._owned(r)
        live = held is not None and held[2] > r.seconds
        if r.command == "renew" and live and r.ttl is not None and r.ttl > 0:
            ends = r.seconds + r.ttl
            self.slots.updateValue((r.slot,), (*held[:2], ends, max(held[3], ends), held[4]))
            self.handle.registerTimer(max(held[3], ends) * 1000)
            return "renewed", r.slot, r.fence
        if r.command == "release" and live and not held[4] or r.command == "complete" and held is not None and held[4]:
            self.slots.updateValue((r.slot,), (None, held[1], 0, 0, False))
            return f"{r.command}d", r.slot, r.fence
        return "lost", r.slot, r.fence

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seconds):
            status, slot, fence = self._answer(r)
            yield Row(resource=key[0], seconds=r.seconds, command=r.command, owner=r.owner, slot=slot, fence=fence, status=status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for (slot,), (owner, fence, *_rest) in list(self.slots.iterator()):
            if owner is not None and not self._busy(slot, now):
                self.slots.updateValue((slot,), (None, fence, 0, 0, False))
                yield Row(resource=key[0], seconds=now, command="timer", owner=owner, slot=slot, fence=fence, status="expired")

    def close(self) -> None:
        pass


def capacity(commands: DataFrame, limit: int, late: str = "1 minute") -> DataFrame:
    """Answers (resource, seconds, command, owner, slot, fence, status) to a stream of COMMANDS with ``limit`` slots for each resource; ``at`` is the
    time of the command and its watermark drives the timers. Needs a state store that holds maps (RocksDB)."""
    keyed = commands.withWatermark("at", late).groupBy("resource")
    return keyed.transformWithState(Slots(limit), ANSWERS, "append", "EventTime")
