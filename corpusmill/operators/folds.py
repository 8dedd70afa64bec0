"""Folds in order: each decision depends on those before it in its group.

Spark deals the rows out by group and sorts them; tasks read them in Arrow batches and carry a small state from row to row, so a group of
any size is worked through in turn and never held as a whole. A group stays in one task, as its order demands.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(rows: DataFrame, group: str, order: list[str], columns: list[str], added: list[tuple[str, str, pa.DataType]], start: Callable, step: Callable[..., list[tuple]]) -> DataFrame:
    """Rows with added columns (name, SQL type, Arrow type). ``step(state, *values of columns)`` changes the state that ``start()`` made for
    the group and gives the added values of each row that comes of this one; none drops it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of, begun = None, None, False
        for batch in batches:
            at, out = [], []
            values = [batch.column(c).to_pylist() for c in columns]
            for i, (g, *v) in enumerate(zip(batch.column(group).to_pylist(), *values, strict=True)):
                if not begun or g != of:
                    state, of, begun = start(), g, True
                for made in step(state, *v):
                    at.append(i)
                    out.append(made)
            kept = batch.take(pa.array(at, pa.int64()))
            made = list(zip(*out, strict=True)) or [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, (_, _, t) in zip(made, added, strict=True)]], names=[*batch.schema.names, *[n for n, _, _ in added]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"`{n}` {t}" for n, t, _ in added]])
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def admitted(rows: DataFrame, key: str, seconds: str, order: str, limit: int, window: int) -> DataFrame:
    """Adds ``admitted``: an event passes if fewer than ``limit`` admitted ones of its key are younger than ``window``. The state is the last
    ``limit`` admitted times."""

    def step(passed: deque, t) -> list[tuple]:
        ok = limit > 0 and (len(passed) < limit or t - passed[0] >= window)
        if ok:
            passed.append(t)
        return [(ok,)]

    return folded(rows, key, [seconds, order], [seconds], [("admitted", "boolean", pa.bool_())], lambda: deque(maxlen=max(limit, 1)), step)


def with_parts(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds ``part``: rows in order fill a part until the next would cross the limit; a larger row has a part of its own."""

    def step(state: list, n) -> list[tuple]:
        part, held, begun = state
        if begun and held + n > limit:
            part, held = part + 1, 0
        state[:] = part, held + n, True
        return [(part,)]

    return folded(rows, group, [order], [size], [("part", "long", pa.int64())], lambda: [0, 0, False], step)


def pieces(content: str, most: int, first_only: bool = False) -> list[str] | None:
    """Runs of whole lines of a text that fit ``most`` characters; a table's two head lines stand on each. None if a line doesn't fit, unless
    only the first run is asked for, which then skips such lines."""
    lines = content.splitlines(keepends=True)
    if len(lines) < 2:
        return None
    head = ""
    if all(line.lstrip().startswith("|") for line in lines[:2]):
        head, lines = "".join(lines[:2]), lines[2:]
    out, held = [], head
    for line in lines:
        if len(held) + len(line) > most and held != head:
            out.append(held)
            if first_only:
                return out
            held = head
        if len(held) + len(line) <= most:
            held += line
        elif not first_only:
            return None
    return out + [held] if held != head else out


def packed(blocks: DataFrame, key: str, place: str, content: str, *, mode: str, limit: int, head: int = 0, between: int = 0) -> DataFrame:
    """Blocks in order with ``batch``, ``piece`` and ``shown``: evidence for one answer ("fast") or for all of it ("full").

    A block takes its characters and ``head`` more, and ``between`` stands between blocks of a batch. Full: a batch ends where the next block
    doesn't fit; a block that fits no batch is cut between lines, and one with a line that fits none has batch null and is shown in no batch.
    Fast: there is batch 0 alone; a block that doesn't fit what is left is passed over, and of one that fits no batch the first lines that do are
    taken. Null contents are empty. The state is the number and the characters of the open batch.
    """
    if mode not in ("fast", "full"):
        raise ValueError(f"no mode {mode}")

    def step(state: list, text: str | None) -> list[tuple]:
        text = text or ""
        whole = len(text) + head <= limit
        parts = [text] if whole else pieces(text, limit - head, mode == "fast")
        if not parts:
            return [] if mode == "fast" else [(None, 0, None)]
        out = []
        for k, part in enumerate(parts):
            batch, held = state
            cost = len(part) + head
            if held is None or held + between + cost <= limit:
                state[:] = batch, cost if held is None else held + between + cost
            elif mode == "fast":
                continue
            else:
                state[:] = batch + 1, cost
            out.append((state[0], k, part))
        return out

    added = [("batch", "long", pa.int64()), ("piece", "long", pa.int64()), ("shown", "string", pa.string())]
    return folded(blocks, key, [place], [content], added, lambda: [0, None], step)
