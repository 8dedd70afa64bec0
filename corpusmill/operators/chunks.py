"""Chunks and index fragments of texts; nothing of a text is lost."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..session import dealt

CHUNK_CHARS, FRAGMENT_BYTES, GAP = 8000, 2000, "\n\n"


def units(text: str) -> Iterator[str]:
    """Blocks between blank lines; a code fence stays whole."""
    held: list[str] = []
    fenced = False
    for line in text.strip().split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if line.strip() or fenced:
            held.append(line)
        elif held:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def pack(text: str, limit: int) -> list[str]:
    """Units in order, joined while they fit; a unit above the limit is a chunk of its own."""
    if len(text.strip()) <= limit:
        return [text.strip()]
    out: list[list[str]] = []
    size = 0
    for unit in units(text):
        if out and size + len(GAP) + len(unit) <= limit:
            out[-1].append(unit)
            size += len(GAP) + len(unit)
        else:
            out.append([unit])
            size = len(unit)
    return [GAP.join(x) for x in out]


def cut(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` bytes that join to the text: at a line end if there is one in the second half, else anywhere."""
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > limit:
        end = raw.rfind(b"\n", at + limit // 2, at + limit) + 1
        if not end:
            end = at + limit
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append(raw[at:end].decode())
        at = end
    return [*out, raw[at:].decode()]


def _exploded(df: DataFrame, key: str, text: str, split, index: str, name: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, index_, texts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, piece in enumerate(split(t or "")):
                    keys.append(k)
                    index_.append(i)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(index_, pa.int32()), pa.array(texts, pa.string())], names=[key, index, name])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {index} int, {name} string")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHUNK_CHARS) -> DataFrame:
    """(key, chunk_index, chunk)."""
    return _exploded(docs, key, text, lambda t: pack(t, limit), "chunk_index", "chunk")


def fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = FRAGMENT_BYTES) -> DataFrame:
    """(key, ordinal, fragment): in order the fragments are the text."""
    return _exploded(docs, key, text, lambda t: cut(t, limit), "ordinal", "fragment")


def section_title(text: Column, lines: int = 50) -> Column:
    """The last heading among the first lines, without its marks."""
    head = F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda x: x.rlike(r"^#{1,6}\s"))
    return bound(head, lambda h: F.when(F.size(h) > 0, F.trim(F.regexp_replace(F.element_at(h, -1), r"^#{1,6}\s+", ""))))


def quote_span(text: Column, quote: Column) -> Column:
    """(start, end) of a quote that occurs exactly once, else null."""
    at = F.instr(text, quote)
    again = F.instr(F.substring(text, at + 1, F.length(text)), quote)
    return F.when((at > 0) & (again == 0) & (quote != ""), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


_RULE = re.compile(r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$")


def cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|").removesuffix("|")
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def pipe_tables(text: str, least: int = 1) -> Iterator[tuple[int, int, list[str], list[list[str]]]]:
    """(first line, line after the last, header, rows) of Markdown tables; an unclosed cell goes on in the next line."""
    lines = text.split("\n")
    at = 0
    while at + 1 < len(lines):
        if not (lines[at].strip().startswith("|") and "|" in lines[at + 1] and _RULE.match(lines[at + 1])):
            at += 1
            continue
        start, rows, at = at, [], at + 2
        while at < len(lines) and lines[at].strip():
            if lines[at].strip().startswith("|"):
                rows.append(lines[at])
            elif rows and not rows[-1].rstrip().endswith("|"):
                rows[-1] += "\n" + lines[at]
            else:
                break
            at += 1
        if len(rows) >= least:
            yield start, at, cells(lines[start]), [cells(r) for r in rows]


def tables(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, table_index, start, end, row_number, header, cells): one row for each table row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (a, b, header, rows) in enumerate(pipe_tables(t or "", least)):
                    out += [(k, n, a, b, i + 1, header, r) for i, r in enumerate(rows)]
            kinds = batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 7
            names = [key, "table_index", "start", "end", "row_number", "header", "cells"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, table_index int, start int, end int, row_number int, header array<string>, cells array<string>")


def field(header: Column, row: Column, names: list[str], fallback: int) -> Column:
    """The cell under the first header that contains one of the names, else the cell at a place (from 1)."""
    at = F.array_position(F.transform(header, lambda h: F.lower(h).rlike("|".join(map(re.escape, names)))), True)
    return F.get(row, F.when(at > 0, at - 1).otherwise(fallback - 1).cast("int"))


def regions(cells_: DataFrame, sheet: str = "sheet", row: str = "row", column: str = "col") -> DataFrame:
    """(sheet, row, first, last): runs of neighbouring filled columns; a cell that comes again counts once. Cells are dealt out once, by rows."""
    from pyspark.sql import Window as W

    places = cells_.select(sheet, row, column)
    once = dealt(places, places.count(), sheet, row).distinct()
    run = F.col(column) - F.row_number().over(W.partitionBy(sheet, row).orderBy(column))
    return once.withColumn("_r", run).groupBy(sheet, row, "_r").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("_r")


def cell_state(raw: Column, formula: Column) -> Column:
    return (
        F.when(raw.isNotNull() & raw.startswith("#"), "error").when(formula.isNotNull() & raw.isNull(), "formula_missing")
        .when(raw.isNull(), "blank").when(raw == "", "empty").otherwise("value")
    )
