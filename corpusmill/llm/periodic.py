"""Periodic runs of words, found by matching aligned blocks within each document.

A run is a stretch of words that repeats with a smallest period q, long enough for LEAST_RUN words and LEAST_TIMES periods, and
that no neighbouring word extends. At scale B, a power of two, the document is cut into aligned blocks of B words; an Aho-Corasick
automaton with the blocks as keys of integers finds where in the document they occur again. A run with a period from B up to 2 * B
holds an aligned block and that block one period later, so occurrences at such distances seed exact extensions to both sides. The
first scale also takes all shorter periods. A block can only recur if both its halves do, so each scale looks at what recurred
at the last one, and most documents end after the first. Keys have FIRST_BLOCK integers at each scale: above the first they are
names of parts of the block, equal for equal words, and the document is searched at each offset within a part, so a search takes time
in proportion to the document however often its words repeat. Nothing is hashed and no distance is cut off: the result is exact.

Documents are judged one by one where Spark has read them: nothing is shuffled, and an executor that is lost repeats its
tasks. Null and empty texts have no words and no runs. Repeated rows get equal results, an empty table an empty one; a long text is
worked through whole in memory proportional to its words. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_array

#: A run has so many words and so many periods at least.
LEAST_RUN, LEAST_TIMES = 24, 3
#: Words of the smallest blocks. A run of LEAST_RUN words holds an aligned block and its next copy for all periods up to it.
FIRST_BLOCK = 8


def _stretch(a: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The longest stretch with period d around words i and i + d, which are equal."""
    n, end, start, step = len(a), i, i, 32
    while end + d < n:
        stop = min(end + step, n - d)
        unequal = np.flatnonzero(a[end:stop] != a[end + d : stop + d])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = stop, step * 2
    step = 32
    while start > 0:
        back = max(start - step, 0)
        unequal = np.flatnonzero(a[back:start] != a[back + d : start + d])
        if len(unequal):
            start = back + int(unequal[-1]) + 1
            break
        start, step = back, step * 2
    return start, end + d


def find(words: list, least: int = LEAST_RUN, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start and period. ``least`` is LEAST_RUN or more, ``times`` 3 or more."""
    import ahocorasick

    if least < LEAST_RUN or times < LEAST_TIMES:
        raise ValueError("shorter runs may hold no aligned block and its copy")
    numbers: dict = {}
    ids = tuple([numbers.setdefault(w, len(numbers)) for w in words])
    n = len(ids)
    if n < least or len(numbers) == n:
        return []
    words_in = np.array(ids, dtype=np.int64)
    names, unit = words_in, 1  # of the ``unit`` words from each place on: equal names, equal words
    runs: dict[tuple[int, int], int] = {}
    over: dict[int, list[tuple[int, int, int]]] = {}  # runs over each smallest block
    block, open_blocks = FIRST_BLOCK, list(range(n // FIRST_BLOCK))
    while open_blocks and 2 * block <= n:
        keys: dict[tuple, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        key_of = dict.fromkeys(open_blocks, 0)
        for j in open_blocks:
            key = tuple(names[j * block : (j + 1) * block : unit].tolist()) if unit > 1 else ids[j * block : (j + 1) * block]
            key_of[j] = k = keys.setdefault(key, len(keys))
            if k == len(keys) - 1:
                automaton.add_word(key, k)
        automaton.make_automaton()
        hits = []
        for first in range(unit):
            sequence = tuple(names[first::unit].tolist()) if unit > 1 else ids
            hits += [(first + (end - FIRST_BLOCK + 1) * unit, k) for end, k in automaton.iter(sequence)]
        if unit > 1:
            hits.sort()
        seen, last = bytearray(len(keys)), {}  # last stretch of each distance
        low, high = (1 if unit == 1 else block), 2 * block - 1
        for at, k in hits:
            seen[k] = min(seen[k] + 1, 2)
            for j in range((at - low) // block, (at - high - 1) // block, -1):
                if j < 0 or key_of.get(j) != k:
                    continue
                i = j * block
                d = at - i
                known = last.get(d)
                if known and known[0] <= i and at + block <= known[1]:
                    continue
                if any(at + block <= e and d % q == 0 for _, e, q in over.get(i // FIRST_BLOCK, ())):
                    continue
                last[d] = start, stop = _stretch(words_in, i, d)
                if stop - start >= max(least, times * d) and runs.get((start, stop), d) >= d:
                    runs[start, stop] = d
                    for b in range(-(-start // FIRST_BLOCK), stop // FIRST_BLOCK):
                        over.setdefault(b, []).append((start, stop, d))
        again = {j for j in open_blocks if seen[key_of[j]] > 1}
        open_blocks = [j // 2 for j in sorted(again) if j % 2 == 0 and j + 1 in again]
        if open_blocks:
            names = np.unique(names[: len(names) - unit] * n + names[unit:], return_inverse=True)[1]
        block, unit = 2 * block, 2 * unit
    return sorted((a, e - a, q) for (a, e), q in runs.items())


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"


def collapse(docs: DataFrame, least: int = LEAST_RUN, times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) for each row: the runs by start and period, the one with the most periods, and the
    words joined by one space without those that a run holds after its first period."""

    def run(batches):
        row = lambda r: dict(zip(("start", "length", "period"), r, strict=True)) if r else None
        for batch in batches:
            sizes, found, tops, texts = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8").split() if text else []
                runs = find(words, least, times)
                if runs:
                    gone = bytearray(len(words))
                    for start, length, q in runs:
                        gone[start + q : start + length] = b"\x01" * (length - q)
                    texts.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]))
                else:
                    texts.append(b" ".join(words))
                sizes.append(len(words))
                found.append([row(r) for r in runs])
                tops.append(row(best(runs)))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(tops, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of all ids (h % 10 = 0 for h, the CRC-32 of the id in decimals) its words with a period from word
    g % n on, g = h / 10: 1 + (n - g % n) / (3 + g % 8) words over and over. Without an id the text stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(text)

    return F.when(doc_id.isNotNull() & (h % 10 == 0), F.element_at(F.transform(F.array(word_array(text)), again), 1)).otherwise(text)
