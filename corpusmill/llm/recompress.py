"""Removal of repeated word passages by recompression.

Each document is a string of word names, two hashes of 64 bits for each word. A round first names runs of equal neighbours, then pairs: a coin on its name puts
every symbol on the left or right side, and a left symbol followed by a right one becomes a new symbol. Names are 64-bit
hashes of what they stand for, so all documents name equal strings alike without a common dictionary. Whether a symbol
stands at a place depends on a bounded context; where that context lies inside a window, every copy of the window holds
the symbol. The highest such symbol (the least name among equals; a plain word always qualifies) is the window's anchor.
Spark rounds then drop the symbols that one document alone has, and verify the windows around the shared ones by 96 bits
made of their words' names, 64 of the first ones and 32 of the second.

A word goes if a window of 13 words over it also starts in a document with a smaller doc_id. Null texts have no words. Rows
with a null doc_id stay whole and remove nothing. Rows with equal doc_id do not remove each other's words. Texts of any
length are read whole; an empty table gives an empty result. Further columns are ignored, so names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Rolling, U64, chunks, freeze, is_shared, least_in, mix, names_of, part_of, remove_repeats, runs, split_by, thaw

WINDOW = 13
ROUNDS = 2
#: A longer text is read in pieces of about this many bytes, cut at white space.
PIECE = 4 << 20
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_KEYS = np.random.default_rng(7).integers(0, 1 << 63, 2, dtype=np.uint64) * U64(2) + U64(1)
_POSITION = U64((1 << 24) - 1)
_ROLLING, _CHECK = Rolling(2), Rolling(3)
_RUN, _LEFT, _RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each word, a second name, its text), for texts below 16 MB together."""
    data = b" ".join(texts) + bytes(8)
    gap = _GAP[np.frombuffer(data, np.uint8, len(data) - 8)]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return *names_of(data, start, size, _KEYS), np.searchsorted(begins, start, side="right") - 1


class Symbols:
    """Symbols of one level: name, first word and the word after the last, context, text."""

    def __init__(self, name, start, end, low, high, text):
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text

    def __len__(self):
        return len(self.name)

    def take(self, at):
        return Symbols(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.text)))

    def outer(self) -> tuple[np.ndarray, np.ndarray]:
        """Context with both neighbours; beyond the text's end there is one more place, which no window holds."""
        same = self.text[1:] == self.text[:-1]
        low = np.r_[self.low[:1] - 1, np.where(same, self.low[:-1], self.start[1:] - 1)]
        high = np.r_[np.where(same, self.high[1:], self.end[:-1] + 1), self.high[-1:] + 1]
        return np.minimum(low, self.low), np.maximum(high, self.high)

    def runs(self) -> "Symbols":
        """Equal neighbours become one symbol."""
        new = np.r_[True, (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(self)] - 1
        low, high = self.outer()
        n = (last - first + 1).astype(np.uint64)
        name = np.where(n > 1, mix(self.name[first] + n * _RUN), self.name[first])
        return Symbols(name, self.start[first], self.end[last], low[first], high[last], self.text[first])

    def pairs(self, salt: int) -> tuple["Symbols", np.ndarray]:
        """A left symbol and a right one behind it become one; also which of the results are pairs."""
        right = mix(self.name ^ U64(0x9E3779B97F4A7C15 * (salt + 1) % (1 << 64))) & U64(1) == 1
        joins = np.r_[~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1]), False]
        second = np.r_[False, joins[:-1]]
        low, high = self.outer()
        out = self.take(~second)
        joined = joins[~second]
        nexts = np.flatnonzero(joins) + 1
        alone = ~joined
        kept_low, kept_high, side = low[~second], high[~second], right[~second]
        out.low = np.where(alone & side, kept_low, out.low)
        out.high = np.where(alone & ~side, kept_high, out.high)
        out.name[joined] = mix(out.name[joined] * _LEFT + self.name[nexts] * _RIGHT)
        out.end[joined] = self.end[nexts]
        out.low[joined] = np.minimum(out.low[joined], self.low[nexts])
        out.high[joined] = np.maximum(out.high[joined], self.high[nexts])
        return out, joined


def _mark(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(first word in its text, text, name of the anchor, two hashes) of each window, for texts below 16 MB together."""
    name, other, text = words_of(texts)
    n = len(name)
    if n < WINDOW:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint32))
    place = np.arange(n)
    key = (name >> U64(2) | U64(2) << U64(62)) & ~_POSITION | place.astype(np.uint64)
    best = least_in(key, WINDOW)
    level = Symbols(name, place, place + 1, place, place + 1, text)
    names = [name]
    for r in range(ROUNDS):
        level, joined = level.runs().pairs(r)
        fits = np.flatnonzero(joined & (level.high - level.low <= WINDOW))
        some = level.take(fits)
        at_name = np.zeros(n, dtype=np.uint64)
        at_name[some.start] = some.name
        names.append(at_name)
        rank = U64(ROUNDS - 1 - r) << U64(62)
        value = (some.name >> U64(2) & U64((1 << 62) - 1) | rank) & ~_POSITION | some.start.astype(np.uint64)
        for shift in range(WINDOW):
            start = some.high - WINDOW + shift
            ok = (start <= some.low) & (start >= 0) & (start < len(best))
            # symbols of a level have distinct contexts' ends, but two may share one: the lesser key must win
            np.minimum.at(best, start[ok], value[ok])
    start = np.arange(len(best))
    inside = text[start] == text[start + WINDOW - 1]
    start, best = start[inside], best[inside]
    where, rank = (best & _POSITION).astype(np.int64), (best >> U64(62)).astype(np.int64)
    anchor = np.empty(len(best), dtype=np.uint64)
    for k in range(ROUNDS + 1):
        has = rank == k
        anchor[has] = names[ROUNDS - k][where[has]]
    anchor = mix(anchor + U64(7))
    powers = np.multiply.accumulate(np.full(WINDOW, _ROLLING.base, dtype=np.uint64))
    checks = np.multiply.accumulate(np.full(WINDOW, _CHECK.base, dtype=np.uint64))
    first, second = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint64)
    for k in range(WINDOW):
        first += name[start + k] * powers[k]
        second += other[start + k] * checks[k]
    counts = np.bincount(text, minlength=len(texts))
    begins = np.cumsum(counts) - counts
    return start - begins[text[start]], text[start], anchor, mix(first), (mix(second) >> U64(32)).astype(np.uint32)


def mark(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As _mark, for texts of any length: pieces overlap so that each window lies in one."""
    if max(map(len, texts), default=0) <= PIECE:
        return _mark(texts)
    found = []
    for i, t in enumerate(texts):
        words = t.split()
        step = max(1, PIECE * len(words) // max(1, len(t)))
        for a in range(0, max(1, len(words) - WINDOW + 1), step):
            start, _, *rest = _mark([b" ".join(words[a : a + step + WINDOW - 1])])
            found.append((start + a, np.full(len(start), i), *rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(texts):
    _, text, name, _, _ = mark(texts)
    new = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])][: len(name)]
    return name[new], text[new]


def _describe(doc, known, texts, shared, g, parts):
    """Windows with a shared anchor; of equal ones all but the first document's are judged here."""
    held = []
    for a, b in chunks(texts):
        start, text, name, h, c = mark(texts[a:b])
        keep = is_shared(name, shared) & known[a + text]
        if keep.any():
            held.append(((a + text[keep]).astype(np.int32), start[keep].astype(np.int32), h[keep], c[keep]))
    if not held:
        return []
    row, at, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    later = _later(doc[row], h, c)
    rows = []
    if later.any():
        rows.append((g % parts, 1, g, freeze(row[later], at[later])))
    row, at, h, c = (x[~later] for x in (row, at, h, c))
    order = np.argsort(h, kind="stable")
    row, at, h, c = (x[order] for x in (row, at, h, c))
    for p, (row, at, h, c) in split_by(part_of(h, parts), [row, at, h, c]):
        ids, index = np.unique(row, return_inverse=True)
        rows.append((p, 0, g, freeze(doc[ids], ids, index.astype(np.uint16 if len(ids) < 1 << 16 else np.int32), at, h.view(np.uint8).reshape(-1, 8).T.copy(), c)))
    return rows


def _later(doc: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id."""
    order = np.lexsort((doc, c, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])][: len(order)]
    starts = np.flatnonzero(new)
    first = np.repeat(doc[order[starts]], np.diff(np.r_[starts, len(order)]))
    out = np.zeros(len(doc), dtype=bool)
    out[order] = doc[order] > first
    return out


def _resolve(todo):
    docs, rows, ats, hs, cs, gs = [], [], [], [], [], []
    for g, data in todo:
        ids_doc, ids, index, at, h, c = thaw(data)
        docs.append(ids_doc[index])
        rows.append(ids[index])
        ats.append(at)
        hs.append(np.ascontiguousarray(h.T).view(np.uint64).ravel())
        cs.append(c)
        gs.append(np.full(len(at), g))
    doc, row, at, h, c, g = (np.concatenate(x) for x in (docs, rows, ats, hs, cs, gs))
    hit = np.flatnonzero(_later(doc, h, c))
    hit = hit[np.lexsort((at[hit], row[hit]))]
    return [(x, freeze(row, at)) for x, (row, at) in split_by(g[hit], [row[hit], at[hit]])]


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())]
)


def _cut(doc, known, texts, verdicts):
    starts: dict[int, list[np.ndarray]] = {}
    for row, at in verdicts:
        for r, (x,) in split_by(row, [at]):
            starts.setdefault(r, []).append(x)
    sizes, spans, kept = [], [], []
    for i, t in enumerate(texts):
        words = t.split()
        sizes.append(len(words))
        if i not in starts:
            spans.append([])
            kept.append(b" ".join(words))
            continue
        change = np.zeros(len(words) + 1, dtype=np.int32)
        s = np.unique(np.concatenate(starts[i]))
        change[s] += 1
        change[s + WINDOW] -= 1
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
        spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
        kept.append(b" ".join(w for a, b in zip([0, *edge[:, 1]], [*edge[:, 0], len(words)], strict=True) for w in words[a:b]))
    ids = pa.array(doc, pa.int64(), mask=~known)
    return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(spans, _ARROW.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=_ARROW)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, kept): the removed word runs of each document and the words that stay, joined by spaces."""
    return remove_repeats(docs, per_name=15, anchors=_anchors, describe=_describe, resolve=_resolve, cut=_cut, schema=SCHEMA)
