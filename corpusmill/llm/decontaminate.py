"""Benchmark decontamination with a BM25 index of the test items.

The benchmark is the index, every passage of every document a query. Impacts are divided by each item's threshold (a share
of the score that the item gives itself), so all items above their thresholds are those with a score of 1 or more. As in
block-max WAND a query is given up as soon as bounds show that no item can reach that: first by the greatest impact of
each of its terms in any item, then by the greatest in a block of items; what is left is scored in full. All passages of
a batch take each step together. A candidate counts as a leak if enough of its question's word triples and of its answer's
words stand in the passage; a question of one or two terms is sought as a whole.

Items are classed by length. Passages of a class hold 2 x S words and start every S words, S being a power of two that is
no less than the items of the class, so each copy of an item lies whole in one passage, and a long item changes nothing for
short ones. Terms are runs of letters and digits, lower-cased. An item without a separate answer takes its last quarter.

Spark counts document frequencies and the mean length over all items. Up to SLICE_TERMS terms of items are indexed and
broadcast at once; a larger benchmark is searched in several passes over the documents, with the same statistics, so neither
that number nor the order of rows changes a result.

Null and empty texts, documents or items, never match. Repeated items and rows are found each for itself. doc_id and item_id
may be of any type, a null one stays null in the result. Texts of any length are searched whole. Without documents, or
without items, nothing is found. Further columns pass through ``clean`` and are ignored by ``leaks``, so names may clash.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize
from .repeats import U64, chunks, mix, names_of

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
LEAST_SCORE = 0.5
LEAST_QUESTION, LEAST_ANSWER = 0.6, 0.6
LEAST_STEP, BLOCK_ITEMS, SLICE_TERMS = 64, 16, 2_000_000
ANSWER_SHARE, LEAST_ANSWER_WORDS = 4, 3
PIECE = 4 << 20
_KEY = np.random.default_rng(4).integers(0, 1 << 63, 1, dtype=np.uint64) * U64(2) + U64(1)
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _pieces(data: bytes) -> list[bytes]:
    """Cuts a long text at white space."""
    out, at = [], 0
    while len(data) - at > PIECE:
        cut = data.find(b" ", at + PIECE)
        if cut < 0:
            break
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each term of all texts in their order."""
    lowered = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    hashes, of = [], []
    for a, b in chunks(lowered):
        part = lowered[a:b]
        if len(part) == 1 and len(part[0]) > PIECE:
            groups = [([p], a) for p in _pieces(part[0])]
        else:
            groups = [(part, a)]
        for group, base in groups:
            data = b" ".join(group) + bytes(8)
            edge = np.flatnonzero(np.diff(np.r_[False, _TERM[np.frombuffer(data, np.uint8)], False].astype(np.int8)))
            start, end = edge[0::2], edge[1::2]
            begins = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])
            hashes += names_of(data, start, end - start, _KEY)
            of.append(base + np.searchsorted(begins, start, side="right") - 1)
    return (np.concatenate(hashes), np.concatenate(of)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n terms in a row, n from 1 to 3; fewer terms have none."""
    if len(h) < n:
        return h[:0]
    if n == 1:
        return mix(h)
    if n == 2:
        return mix(h[:-1] * U64(3) + mix(h[1:] + U64(1)) * U64(5))
    return mix(h[:-2] * U64(3) + mix(h[1:-1] + U64(1)) * U64(5) + mix(h[2:] + U64(2)))


def item_terms(question: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the question, of the answer); without an answer the question's end stands for it."""
    (q, _), (a, _) = terms([question]), terms([answer])
    if not len(a):
        cut = min(len(q), max(LEAST_ANSWER_WORDS, len(q) // ANSWER_SHARE))
        q, a = q[: len(q) - cut], q[len(q) - cut :]
    return q, a


class Postings:
    """Inverted lists of the items of one length class, with the greatest impact of each list and of each block of items."""

    def __init__(self, step: int, members: list[int], impacts: list[dict[int, float]], terms: int) -> None:
        """members: item numbers; impacts: of each, from term number to impact."""
        self.step, self.members = step, members
        lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for i, impact in enumerate(impacts):
            for t, x in impact.items():
                lists[t].append((i, x))
        self.starts = np.cumsum([0] + [len(x) for x in lists])
        self.items = np.array([i for x in lists for i, _ in x], dtype=np.int64)
        self.impacts = np.array([v for x in lists for _, v in x])
        self.list_max = np.array([max((v for _, v in x), default=0.0) for x in lists])
        blocks: list[list[tuple[int, float]]] = []
        for x in lists:
            best: dict[int, float] = {}
            for i, v in x:
                best[i // BLOCK_ITEMS] = max(v, best.get(i // BLOCK_ITEMS, 0.0))
            blocks.append(sorted(best.items()))
        self.block_starts = np.cumsum([0] + [len(x) for x in blocks])
        self.blocks = np.array([b for x in blocks for b, _ in x], dtype=np.int64)
        self.block_max = np.array([v for x in blocks for _, v in x])

    def search(self, of: np.ndarray, inner: np.ndarray, term: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, passage of it, item number, score) of all passages that score 1 or more. A term stands at word ``inner`` of
        text ``of``; sizes: words of each text."""
        # passage k of a text holds its words k*S to (k+2)*S, so each word is in two, the first S in one
        count = -(-sizes // self.step) + 1
        base = np.cumsum(count) - count
        late = base[of] + inner // self.step
        early = inner >= self.step
        passage, term = np.r_[late, late[early] - 1], np.r_[term, term[early]]
        key = np.unique(passage * len(self.list_max) + term)
        passage, term = key // len(self.list_max), key % len(self.list_max)
        # lists: can the terms together reach 1 in any item?
        keep = (np.bincount(passage, self.list_max[term]) >= 1 - 1e-9)[passage] if len(passage) else np.empty(0, dtype=bool)
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return []
        names, passage = np.unique(passage, return_inverse=True)
        # blocks: can they in any item of the block?
        width = -(-len(self.members) // BLOCK_ITEMS)
        p, place = _expand(passage, term, self.block_starts)
        key, where = np.unique(p * width + self.blocks[place], return_inverse=True)
        open_blocks = key[np.bincount(where, self.block_max[place]) >= 1 - 1e-9]
        if not len(open_blocks):
            return []
        p, place = _expand(passage, term, self.starts)
        block = p * width + self.items[place] // BLOCK_ITEMS
        some = open_blocks[np.minimum(np.searchsorted(open_blocks, block), len(open_blocks) - 1)] == block
        p, place = p[some], place[some]
        key, where = np.unique(p * len(self.members) + self.items[place], return_inverse=True)
        score = np.bincount(where, self.impacts[place])
        text_of = np.repeat(np.arange(len(sizes)), count)
        out = []
        for k in np.flatnonzero(score >= 1 - 1e-9):
            p, item = divmod(int(key[k]), len(self.members))
            text = int(text_of[names[p]])
            out.append((text, int(names[p] - base[text]), self.members[item], float(score[k])))
        return out


class Index:
    """Impacts of terms in items, divided by the items' thresholds."""

    def __init__(self, rows: list[tuple], n: int | None = None, mean: float | None = None, df: dict[int, int] | None = None) -> None:
        """rows: (item_id, terms of the question, of the answer); n, mean and df: number of all items, their mean length and
        how many hold a term, of these rows if not given."""
        rows = [r for r in rows if len(r[1]) + len(r[2])]
        self.ids = [i for i, _, _ in rows]
        self.gram = [min(3, max(1, len(q))) for _, q, _ in rows]
        self.questions = [np.unique(grams(q, k)) for k, (_, q, _) in zip(self.gram, rows, strict=True)]
        self.answers = [np.unique(a) for _, _, a in rows]
        bags = [Counter(np.r_[q, a].tolist()) for _, q, a in rows]
        sizes = [sum(b.values()) for b in bags]
        n = len(rows) if n is None else n
        mean = sum(sizes) / max(1, n) if mean is None else mean
        df = Counter(t for b in bags for t in b) if df is None else df
        self.vocabulary = np.array(sorted({t for b in bags for t in b}), dtype=np.uint64)
        number = {t: k for k, t in enumerate(self.vocabulary.tolist())}
        classes: dict[int, list[int]] = {}
        impacts: list[dict[int, float]] = []
        for i, (bag, size) in enumerate(zip(bags, sizes, strict=True)):
            step = LEAST_STEP
            while step < size:
                step *= 2
            classes.setdefault(step, []).append(i)
            norm = K1 * (1 - B + B * size / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in bag.items()}
            threshold = LEAST_SCORE * sum(impact.values())
            impacts.append({number[t]: x / threshold for t, x in impact.items()})
        self.classes = [Postings(step, members, [impacts[i] for i in members], len(number)) for step, members in sorted(classes.items())]
        bits = 12
        while bits < 24 and (1 << bits) < 16 * len(number):
            bits += 1
        self.mask = U64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.vocabulary & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the index's terms in h."""
        at = np.flatnonzero(self.maybe[h & self.mask])
        k = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[k] == h[at]
        return at[real], k[real]

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score over threshold, question overlap, answer overlap) of each leak; the best passage of each pair."""
        h, of = terms(texts)
        if not len(self.ids) or not len(h):
            return []
        at, term = self.find(h)
        first = np.searchsorted(of, np.arange(len(texts)))
        sizes = np.diff(np.r_[first, len(h)])
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for postings in self.classes:
            for text, passage, item, score in postings.search(of[at], at - first[of[at]], term, sizes):
                start = first[text] + passage * postings.step
                words = h[start : min(start + 2 * postings.step, first[text] + sizes[text])]
                q = float(np.isin(self.questions[item], grams(words, self.gram[item])).mean()) if len(self.questions[item]) else 1.0
                a = float(np.isin(self.answers[item], words).mean()) if len(self.answers[item]) else 1.0
                if q >= LEAST_QUESTION and a >= LEAST_ANSWER:
                    found[text, item] = max(found.get((text, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(t, i, *v) for (t, i), v in sorted(found.items())]


def _expand(passage: np.ndarray, term: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, place in the lists) of all postings of the passages' terms."""
    n = starts[term + 1] - starts[term]
    ends = np.cumsum(n)
    return np.repeat(passage, n), np.repeat(starts[term] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, q, a): the terms of each item that has some, as hashes."""
    cols = benchmark.columns
    question = F.col("question") if "question" in cols else F.col("text")
    answer = F.col("answer") if "answer" in cols else F.lit(None).cast("string")
    rows = benchmark.select("item_id", question.alias("question"), answer.alias("answer"))

    def run(batches):
        for batch in batches:
            both = [item_terms(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True)]
            sides = [pa.array([x[k].view(np.int64) for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *sides], names=["item_id", "q", "a"])

    out = rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, q array<long>, a array<long>")
    return out.where(F.size("q") + F.size("a") > 0)


def indexes(benchmark: DataFrame, slice_terms: int | None = None):
    """An index after the other, each of about ``slice_terms`` terms of items, with the statistics of all items."""
    items = materialize(items_of(benchmark))
    size = F.size("q") + F.size("a")
    n, total = items.agg(F.count("*"), F.sum(size)).first()
    if not n:
        return
    df = materialize(items.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("term")).groupBy("term").count())
    slices = -(-total // (slice_terms or SLICE_TERMS))
    for k in range(slices):
        mine = items.where(F.pmod(F.xxhash64("q", "a"), F.lit(slices)) == k)
        own = mine.select(F.explode(F.concat("q", "a")).alias("term")).distinct()
        counts = {np.int64(r["term"]).view(np.uint64).item(): r["count"] for r in df.join(own, "term", "left_semi").toLocalIterator()}
        unsigned = lambda x: np.array(x, dtype=np.int64).view(np.uint64)
        yield Index([(r["item_id"], unsigned(r["q"]), unsigned(r["a"])) for r in mine.toLocalIterator()], n, total / n, counts)


def _passes(docs: DataFrame, benchmark: DataFrame, one, keep_going) -> list[DataFrame]:
    """Results of ``one(docs, broadcast index)`` for each index. With several, each result is written before the next index is
    made, so that one alone is held; ``keep_going`` gives the documents for the next pass."""
    spark, out, last = docs.sparkSession, [], None
    for index in indexes(benchmark):
        if last is not None:
            out.append(materialize(one(docs, last)))
            docs = keep_going(docs, out[-1])
            last.unpersist()
        last = spark.sparkContext.broadcast(index)
    return [*out, one(docs, last)] if last is not None else out


#: Texts looked up together.
GROUP = 256


def _groups(texts: list) -> list[list]:
    return [texts[a : a + GROUP] for a in range(0, len(texts), GROUP)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each item that a document holds."""
    rows = docs.select("doc_id", "text")
    kinds = {"doc_id": rows.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = ", ".join([*[f"{n} {t.simpleString()}" for n, t in kinds.items()], *[f"{n} double" for n in ("score", "question_overlap", "answer_overlap")]])

    def one(docs, index):
        def run(batches):
            for batch in batches:
                rows, items = [], []
                for g, texts in enumerate(_groups(batch.column("text").to_pylist())):
                    for t, i, s, q, a in index.value.leaks(texts):
                        rows.append((g * GROUP + t, s * LEAST_SCORE, q, a))
                        items.append(index.value.ids[i])
                at, *scores = list(zip(*rows, strict=True)) or [[]] * 4
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, to_arrow_type(kinds["item_id"])), *[pa.array(x, pa.float64()) for x in scores]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, schema)

    found = _passes(rows, benchmark, one, lambda docs, _: docs)
    return reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], schema)) if len(found) != 1 else found[0]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""

    def one(docs, index):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for g, texts in enumerate(_groups(batch.column("text").to_pylist())):
                    keep[[g * GROUP + t for t, *_ in index.value.leaks(texts)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    left = _passes(docs, benchmark, one, lambda _, kept: kept)
    return left[-1] if left else docs
