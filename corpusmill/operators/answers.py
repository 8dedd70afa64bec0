"""JSON that models answer: whole, cut off at a limit, or wrapped in talk; and one canonical form of equal values."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

_DECODER = json.JSONDecoder()
_BLANK = " \t\n\r"


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    return at


def members(text: str, at: int) -> tuple[list | dict, bool]:
    """(the complete members of the array or object that opens at ``at``, whether it is closed). Each character is read once, or twice at the
    member that breaks off."""
    array = text[at] == "["
    out: list | dict = [] if array else {}
    at = _skip(text, at + 1)
    while at < len(text) and text[at] not in "]}":
        try:
            key = None
            if not array:
                key, at = _DECODER.raw_decode(text, at)
                at = _skip(text, at)
                if not isinstance(key, str) or text[at : at + 1] != ":":
                    return out, False
                at = _skip(text, at + 1)
            value, at = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            return out, False
        if array:
            out.append(value)
        else:
            out[key] = value
        at = _skip(text, at)
        if at < len(text) and text[at] == ",":
            at = _skip(text, at + 1)
        elif at < len(text) and text[at] not in "]}":
            return out, False
    return out, at < len(text) and text[at] == ("]" if array else "}")


def parsed(text: str | None) -> tuple[str, object]:
    """(status, value): "whole" for JSON; "found" for a closed array or object behind other text; "recovered" for the complete members of the first
    one that breaks off; else "none"."""
    try:
        return "whole", json.loads(text or "")
    except (ValueError, RecursionError):
        pass
    starts = [i for i in ((text or "").find(c) for c in "[{") if i >= 0]
    if not starts:
        return "none", None
    value, closed = members(text, min(starts))
    return ("found" if closed else "recovered", value) if closed or value else ("none", None)


def canonical(value: object) -> str:
    """Keys in order, no white space, ASCII: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def answers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, value): each text's JSON in canonical form, null where there is none. Null and empty texts have none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [parsed(t) for t in batch.column(text).to_pylist()]
            values = [None if s == "none" else canonical(v) for s, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([s for s, _ in found], pa.string()), pa.array(values, pa.string())], names=[key, "status", "value"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, status string, value string")
