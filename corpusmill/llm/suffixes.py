"""Removal of repeated byte strings by bucket-pointer refinement over a sparse suffix array.

Of all suffixes only those at content-defined anchors are sorted: the anchor of a 50-byte window is its 16-byte gram with
the least hash, so equal windows have equal anchors at equal offsets. The initial buckets hold the anchors with equal
grams. Around the anchors of a bucket every offset then has a bucket of its first 8 bytes, and these are refined by sorting
on pairs of bucket numbers, those at the offset and those as many bytes later as the bucket is deep: 16 bytes from 8, 32
from 16, and a window of 50 from two of 32. Each round reuses the numbers of the one before for all offsets; what is alone in
its bucket leaves. Bytes are compared, hashes only find candidates.

A byte goes if a window over it also starts in a document with a smaller doc_id. Null texts are empty. Rows with a null
doc_id stay whole and remove nothing. Rows with equal doc_id do not remove each other's bytes. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Rolling, U64, chunks, freeze, is_shared, least_in, mix, part_of, remove_repeats, runs, split_by, thaw

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM
#: A longer text is marked in pieces of this many bytes.
PIECE = 4 << 20
#: Bytes of the first buckets, and anchors refined at once, about.
FIRST, SLICE = 8, 1 << 16
_POSITION = U64((1 << 24) - 1)
_ROLLING = Rolling()


def _mark(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(name, text, position, least and most bytes before it in a window that chose it), for texts below 16 MB together."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < WINDOW:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    grams = _ROLLING.grams(_ROLLING.prefix(data), GRAM)
    key = grams & ~_POSITION | np.arange(len(grams), dtype=np.uint64)
    chosen = (least_in(key, REACH + 1) & _POSITION).astype(np.int64)
    start = np.arange(len(chosen))
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(chosen)]
    inside = start + WINDOW <= ends[text]
    start, chosen = start[inside], chosen[inside]
    first = runs(chosen)
    last = np.r_[first[1:], len(chosen)] - 1
    at = chosen[first]
    of = text[start[first]]
    begins = ends - [len(t) for t in texts]
    return mix(grams[at] ^ U64(0x5851F42D4C957F2D)), of, at - begins[of], at - start[last], at - start[first]


def mark(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As _mark, for texts of any length: pieces overlap so that each window lies in one."""
    if max(map(len, texts), default=0) <= PIECE:
        return _mark(texts)
    found = []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            name, _, at, lo, hi = _mark([t[a : a + PIECE + WINDOW - 1]])
            found.append((name, np.full(len(name), i), at + a, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(texts):
    name, text, *_ = mark(texts)
    return name, text


def _describe(doc, known, texts, shared, g, parts):
    """Surviving anchors with the bytes that their windows can hold; all but the first of equal ones are judged here."""
    rows, local = [], []
    held = []
    for a, b in chunks(texts):
        name, text, at, lo, hi = mark(texts[a:b])
        keep = is_shared(name, shared) & known[a + text]
        name, text, at, lo, hi = (x[keep] for x in (name, text, at, lo, hi))
        if not len(name):
            continue
        part = texts[a:b]
        pad = bytes(REACH)
        data = np.frombuffer(pad + b"".join(part) + pad, np.uint8)
        begins = np.cumsum([0] + [len(t) for t in part])[text] + at
        around = np.lib.stride_tricks.sliding_window_view(data, WINDOW + REACH)[begins].copy()
        place = np.arange(WINDOW + REACH)
        around[(place < (REACH - hi)[:, None]) | (place >= (REACH + WINDOW - lo)[:, None])] = 0
        held.append((name, a + text, at, lo.astype(np.uint8), hi.astype(np.uint8), around))
    if not held:
        return []
    name, row, at, lo, hi, around = (np.concatenate(x) for x in zip(*held, strict=True))
    digest = np.ascontiguousarray(np.pad(around, ((0, 0), (0, 4)))).view("<u8")
    weight = _ROLLING.table[: digest.shape[1]]
    digest = mix((digest * weight).sum(axis=1, dtype=np.uint64) + lo.astype(np.uint64) * U64(1 << 32) + hi.astype(np.uint64))
    order = np.argsort(digest, kind="stable")
    starts = runs(digest[order])
    first = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]))
    same = (around[order] == around[first]).all(axis=1) & (lo[order] == lo[first]) & (hi[order] == hi[first]) & (name[order] == name[first])
    later = same & (doc[row[order]] > doc[row[first]])
    done = np.zeros(len(row), dtype=bool)
    done[order] = later
    if done.any():
        low, high = lo[done].astype(np.uint64), hi[done].astype(np.uint64)
        local = freeze(row[done].astype(np.int32), at[done].astype(np.int32), (U64(1) << (high + U64(1))) - (U64(1) << low))
        rows.append((g % parts, 1, g, local))
    todo = ~done
    arrays = [doc[row], row.astype(np.int32), at.astype(np.int32), lo, hi, around]
    for p, part in split_by(part_of(name[todo], parts), [x[todo] for x in arrays]):
        rows.append((p, 0, g, freeze(*part)))
    return rows


def _numbers(rows: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers of n rows: ``rows`` with equal keys share one, -1 for rows that have no other in their bucket."""
    _, number, size = np.unique(key, return_inverse=True, return_counts=True)
    many = size[number] > 1
    out = np.full(n, -1, dtype=np.int32)
    out[rows[many]] = number[many]
    return out


def _refined(buckets: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Buckets of twice the depth at each offset, from the numbers there and of the buckets ``depth`` bytes later."""
    out = []
    for here, later in zip(buckets, buckets[depth:]):  # noqa: B905
        rows = np.flatnonzero((here >= 0) & (later >= 0))
        out.append(_numbers(rows, here[rows].astype(np.int64) * len(here) + later[rows], len(here)))
    return out


def _repeated(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row the windows that a row of a smaller doc has too, bit d for the one that begins d bytes before the anchor.
    Rows with equal grams stand in the order of their docs."""
    n = len(doc)
    first, last = REACH - hi.astype(np.int64), REACH + WINDOW - lo.astype(np.int64)
    buckets = []
    for at in range(WINDOW + REACH - FIRST + 1):
        rows = np.flatnonzero((first <= at) & (at + FIRST <= last))
        buckets.append(_numbers(rows, np.ascontiguousarray(around[rows, at : at + FIRST]).view("<u8").ravel(), n))
    depth = FIRST
    while 2 * depth <= WINDOW:
        buckets, depth = _refined(buckets, depth), 2 * depth
    mask = np.zeros(n, dtype=np.uint64)
    for start in range(REACH + 1):
        here, later = buckets[start], buckets[start + WINDOW - depth]
        rows = np.flatnonzero((here >= 0) & (later >= 0))
        _, least, number = np.unique(here[rows].astype(np.int64) * n + later[rows], return_index=True, return_inverse=True)
        mask[rows[doc[rows] > doc[rows[least[number]]]]] |= U64(1 << (REACH - start))
    return mask


def _resolve(todo):
    parts = [thaw(d) for _, d in todo]
    g = np.repeat([g for g, _ in todo], [len(p[0]) for p in parts])
    doc, row, at, lo, hi, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    gram = np.ascontiguousarray(around[:, REACH : REACH + GRAM]).view("<u8")
    order = np.lexsort((doc, gram[:, 0], gram[:, 1]))
    g, doc, row, at, lo, hi, around, gram = (x[order] for x in (g, doc, row, at, lo, hi, around, gram))
    starts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]).any(axis=1)])
    mask = np.zeros(len(doc), dtype=np.uint64)
    a = 0
    while a < len(doc):  # whole buckets of the initial grams, SLICE rows at a time
        k = np.searchsorted(starts, a + SLICE, side="right") - 1
        b = len(doc) if a + SLICE >= len(doc) else int(starts[k]) if starts[k] > a else int(np.r_[starts, len(doc)][k + 1])
        mask[a:b] = _repeated(doc[a:b], lo[a:b], hi[a:b], around[a:b])
        a = b
    hit = np.flatnonzero(mask)
    return [(x, freeze(*arrays)) for x, arrays in split_by(g[hit], [row[hit], at[hit], mask[hit]])]


SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


def _cut(doc, known, texts, verdicts):
    starts: dict[int, list[np.ndarray]] = {}
    for row, at, mask in verdicts:
        for d in range(REACH + 1):
            has = (mask >> U64(d)) & U64(1) == 1
            if has.any():
                for r, (x,) in split_by(row[has], [at[has] - d]):
                    starts.setdefault(r, []).append(x)
    spans, kept = [], []
    for i, t in enumerate(texts):
        if i not in starts:
            spans.append([])
            kept.append(t)
            continue
        change = np.zeros(len(t) + 1, dtype=np.int32)
        s = np.unique(np.concatenate(starts[i]))
        change[s] += 1
        np.add.at(change, s + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
    ids = pa.array(doc, pa.int64(), mask=~known)
    return pa.table([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, _ARROW.field("spans").type), pa.array(kept, pa.binary())], schema=_ARROW)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed byte runs of each document and the bytes that stay."""
    return remove_repeats(docs, per_name=18, anchors=_anchors, describe=_describe, resolve=_resolve, cut=_cut, schema=SCHEMA)
