"""Shared steps of the two operators that remove repeated passages.

Both mark content-defined anchors in every document, so that every window of a fixed length holds an anchor whose choice
depends on nothing but the window. Three exchanges follow:

1. Anchor names are dealt by name; a name that one document alone has is dropped (``shared_names``).
2. Documents meet their surviving names and send what is needed to tell windows apart, again dealt by name.
3. Documents meet the verdicts on their windows and are cut.

Hot names stay small because every task first merges what it has: a name that two documents of one batch share is
known to survive, and only one row of it goes to the exchange. Texts travel as zstd frames.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for

U64 = np.uint64
#: Bytes of text in one group of documents, and names in one group of names: what one task holds in memory.
GROUP_BYTES, GROUP_NAMES = 4 << 20, 1 << 20
#: Bytes of text on which arrays are made at once.
CHUNK_BYTES = 1 << 20
_MIX = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range."""
    x = (x ^ (x >> U64(31))) * _MIX[0]
    x = (x ^ (x >> U64(29))) * _MIX[1]
    return x ^ (x >> U64(32))


class Rolling:
    """Polynomial hashes of all substrings, modulo 2**64, with a random value for each byte."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 3
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes, the empty one first."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal bytes get equal hashes wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.inverses[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.inverses[:n]) if n > 0 else np.empty(0, dtype=np.uint64)


_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def names_of(data: bytes, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """A hash of each data[start:start + size] under each key; ``data`` ends with eight bytes that no span holds, no size is 0.

    Eight bytes at a time are mixed with a key of their place, so spans of up to eight bytes never meet and longer ones meet
    only by chance, however regular the bytes.
    """
    if not len(start):
        return [np.empty(0, dtype=np.uint64) for _ in keys]
    lanes = (size + 7) // 8
    first = np.cumsum(lanes) - lanes
    span = np.repeat(np.arange(len(start)), lanes)
    lane = np.arange(len(span)) - first[span]
    at = start[span] + 8 * lane
    value = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at] & _LANE[np.minimum(8, start[span] + size[span] - at)]
    place = lane.astype(np.uint64)
    return [mix(np.add.reduceat(mix((value + k) ^ mix(place + k)), first) + size.astype(np.uint64) * k) for k in keys]


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return keys


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about CHUNK_BYTES; a longer text has a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, dtype=np.int64)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(name).to_pylist()


def texts_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc_id, whether it is there, text as bytes); a null text is empty."""
    ids = batch.column("doc_id")
    known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    doc = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return doc, known, [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % U64(groups)).astype(np.int64)


# ---------------------------------------------------------------- frames of texts


def pack(doc: np.ndarray, known: np.ndarray, texts: list[bytes]) -> bytes:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    head = np.array([len(texts)], dtype=np.int64).tobytes() + doc.tobytes() + known.astype(np.int8).tobytes() + sizes.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc = np.frombuffer(raw, np.int64, n, 8)
    known = np.frombuffer(raw, np.int8, n, 8 + 8 * n).astype(bool)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    at = np.r_[0, np.cumsum(sizes)] + 8 + 17 * n
    return doc, known, [raw[at[i] : at[i + 1]] for i in range(n)]


def packed(docs: DataFrame, groups: int) -> DataFrame:
    """Rows (g, frame): the documents of group g in a batch."""

    def deal(batches):
        for batch in batches:
            doc, known, texts = texts_of(batch)
            g = group_of(doc, groups)
            order = np.argsort(g, kind="stable")
            starts = np.r_[runs(g[order]), len(g)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                pick = order[a:b]
                frame = pack(doc[pick], known[pick], [texts[i] for i in pick])
                yield pa.RecordBatch.from_arrays([pa.array([int(g[pick[0]])], pa.int64()), pa.array([frame], pa.binary())], names=["g", "frame"])

    return docs.mapInArrow(deal, "g long, frame binary")


def gathered(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All documents of a group by id and text, so that a row has the same number each time."""
    parts = [unpack(f) for f in frames]
    doc = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    known = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, bool)
    texts = [t for p in parts for t in p[2]]
    order = sorted(range(len(texts)), key=lambda i: (doc[i], known[i], texts[i]))
    return doc[order], known[order], [texts[i] for i in order]


def freeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays))


def thaw(frame: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(frame))


def split_by(p: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows of each value of p, in their order."""
    order = np.argsort(p, kind="stable")
    starts = np.r_[runs(p[order]), len(p)]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield int(p[order[a]]), [x[order[a:b]] for x in arrays]


PAYLOAD = "p long, kind byte, g long, data binary"


def payloads(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = pa.int64(), pa.int8(), pa.int64(), pa.binary()
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("p", "kind", "g", "data"), columns, kinds, strict=True)})


# ---------------------------------------------------------------- names that two documents share

Anchors = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def sizes_for(docs: DataFrame, per_name: int) -> tuple[int, int]:
    """(groups of documents, groups of names) for these texts; per_name: bytes of text for each anchor, about."""
    groups, total = parts_for(docs, F.octet_length("text"), GROUP_BYTES)
    return groups, max(1, groups // 4, -(-total // (per_name * GROUP_NAMES)))


def _rows(p: np.ndarray, name: np.ndarray, g: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each p: its names and the groups of their documents."""
    order = np.lexsort((name, p))
    p, name, g = p[order], name[order], g[order]
    starts = np.r_[runs(p), len(p)]
    cut = [slice(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(p[c.start]) for c in cut], pa.int64()),
            pa.array([kind] * len(cut), pa.int8()),
            pa.array([planes(name[c]) for c in cut], pa.binary()),
            pa.array([g[c].astype(np.int32).tobytes() for c in cut], pa.binary()),
        ],
        names=["p", "kind", "name", "g"],
    )


def planes(name: np.ndarray) -> bytes:
    """Six low bytes of each name, byte by byte: in sorted order the upper ones compress."""
    return np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


LOW48 = U64((1 << 48) - 1)


def part_of(name: np.ndarray, parts: int) -> np.ndarray:
    """The group of a name by its upper bits."""
    return ((name >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def shared_names(docs: DataFrame, anchors: Anchors, groups: int, parts: int) -> DataFrame:
    """Rows (g, name): names (48 bits of them) of anchors in documents of group g that another document may have too.

    None is missing; a name that only shares its 48 bits with another may be there as well.
    """

    def send(batches):
        for batch in batches:
            doc, known, texts = texts_of(batch)
            g = group_of(doc, groups)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            live = np.flatnonzero(known)
            some = [texts[i] for i in live]
            for a, b in chunks(some):
                name, at = anchors(some[a:b])
                order = np.lexsort((at, name))
                name, at = name[order], at[order]
                new = np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])] if len(name) else np.empty(0, dtype=bool)
                if len(name):
                    found.append((name[new], live[a + at[new]]))
            if not found:
                continue
            name, row = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(name, kind="stable")
            name, row = name[order], row[order]
            starts = runs(name)
            count = np.diff(np.r_[starts, len(name)])
            own = g[row]
            # known in one document of this batch: others decide
            once = starts[count == 1]
            yield _rows(part_of(name[once], parts), name[once], own[once], 0)
            if (count > 1).any():
                # known in two documents here: it survives for all of them; one row tells the others
                many = np.repeat(count > 1, count)
                first = starts[count > 1]
                yield _rows(part_of(name[first], parts), name[first], np.full(len(first), -1), 1)
                yield _rows(own[many] % parts, name[many], own[many], 2)

    def keep(key, table):
        kinds = column(table, "kind")
        names = [unplanes(x) for x in column(table, "name")]
        gs = [np.frombuffer(x, np.int32) for x in column(table, "g")]
        out_name = [n for n, k in zip(names, kinds, strict=True) if k == 2]
        out_g = [x for x, k in zip(gs, kinds, strict=True) if k == 2]
        if len(out_name) < len(names):
            name = np.concatenate([n for n, k in zip(names, kinds, strict=True) if k < 2])
            g = np.concatenate([x for x, k in zip(gs, kinds, strict=True) if k < 2])
            order = np.argsort(name, kind="stable")
            name, g = name[order], g[order]
            starts = runs(name)
            count = np.diff(np.r_[starts, len(name)])
            alive = np.repeat((count > 1) | (np.minimum.reduceat(g, starts) < 0), count) & (g >= 0)
            out_name.append(name[alive])
            out_g.append(g[alive])
        name, g = np.concatenate(out_name), np.concatenate(out_g).astype(np.int64)
        order = np.lexsort((name, g))
        name, g = name[order], g[order]
        starts = np.r_[runs(g), len(g)]
        cut = [slice(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return pa.table({"g": pa.array([int(g[c.start]) for c in cut], pa.int64()), "name": pa.array([planes(name[c]) for c in cut], pa.binary())})

    return docs.mapInArrow(send, "p long, kind byte, name binary, g binary").groupBy("p").applyInArrow(keep, "g long, name binary")


def is_shared(name: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether each name is among the sorted shared ones."""
    if not len(shared):
        return np.zeros(len(name), dtype=bool)
    low = name & LOW48
    at = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
    return shared[at] == low


# ---------------------------------------------------------------- the three exchanges


def remove_repeats(docs: DataFrame, *, per_name: int, anchors: Anchors, describe, resolve, cut, schema: str) -> DataFrame:
    """Runs the three exchanges.

    describe(doc, texts, shared, g, parts) gives rows of PAYLOAD: kind 0 for resolve, kind 1 a verdict on g already.
    resolve(list of (g, data)) gives (g, verdict) pairs. cut(doc, known, texts, verdicts) gives the result as a table.
    Rows without a doc_id take no part and are cut where they are, by no verdict.
    """
    unnamed = docs.where(F.col("doc_id").isNull()).select("doc_id", "text")
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    groups, parts = sizes_for(docs, per_name)
    frames = packed(docs, groups)
    shared = shared_names(docs, anchors, groups, parts)

    def meet(key, left, right):
        doc, known, texts = gathered(column(left, "frame"))
        names = [unplanes(x) for x in column(right, "name")]
        if not names or not len(doc):
            return payloads([])
        return payloads(describe(doc, known, texts, np.unique(np.concatenate(names)), int(key[0].as_py()), parts))

    def judge(key, table):
        kinds, gs, data = (column(table, c) for c in ("kind", "g", "data"))
        out = [(0, 0, g, d) for k, g, d in zip(kinds, gs, data, strict=True) if k == 1]
        todo = [(g, d) for k, g, d in zip(kinds, gs, data, strict=True) if k == 0]
        out += [(0, 0, g, d) for g, d in resolve(todo)] if todo else []
        return payloads(out).select(["g", "data"])

    def finish(key, left, right):
        doc, known, texts = gathered(column(left, "frame"))
        return cut(doc, known, texts, [thaw(x) for x in column(right, "data")])

    def pass_by(batches):
        for batch in batches:
            yield from cut(*texts_of(batch), []).to_batches()

    met = frames.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(meet, PAYLOAD)
    verdicts = met.groupBy("p").applyInArrow(judge, "g long, data binary")
    done = frames.groupBy("g").cogroup(verdicts.groupBy("g")).applyInArrow(finish, schema)
    return done.unionByName(unnamed.mapInArrow(pass_by, schema))
