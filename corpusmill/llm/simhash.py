"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits are grouped so that correlated bits share a partition. Each partition gets a threshold of its own, by
dynamic programming on the number of candidates that bit statistics over all fingerprints predict; if the thresholds plus
one add up to more than the distance sought, every pair within the distance agrees up to the threshold in some partition.
Fingerprints are dealt by partition value, near values are probed, and every candidate's full distance is verified. A
bucket returns a spanning forest, not its pairs; stars then contract to components.

Documents with equal fingerprints are one node, so copies cost nothing. Null texts are empty, texts without words have the
fingerprint zero and link to each other like any other. Rows with a null doc_id get a fingerprint and no component.
Repeated rows get equal results; rows of one doc_id with different texts are judged each by its own fingerprint. An empty
table gives an empty result. Further columns are ignored, so names may clash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, materialize
from .graph import components, least_ids, numbered
from .repeats import U64, column, freeze, mix, runs, split_by, thaw

SEED = 42
#: A bucket with more nodes than this, and than a ten-thousandth of all, is compared in blocks by several tasks.
BLOCK = 4096
#: Fingerprint words of the pairs that are compared at once.
STEP = 1 << 21
#: Tasks that count bits: each sends one row for each bit, whatever it has read.
STATISTICS_TASKS = 1024
#: Cost of a probe and of a candidate, in the same unit.
PROBE_COST, CANDIDATE_COST = 1.0, 0.01


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of all shingles of lower-cased words; a shorter text is one shingle, an empty one has none."""
    w = text.translate(LOWER_BYTES).split()
    if len(w) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, SEED) for x in map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False))), np.uint64, len(w) - size + 1)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8) * 256


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits that are set in over half the hashes; further words of bits come from mixed hashes."""
    out = np.zeros(words, dtype=np.uint64)
    for k in range(words):
        x = h if k == 0 else mix(h + U64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        if len(x):
            seen = np.bincount((x.astype("<u8").view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
            ones = (seen @ _BITS).ravel() * 2 > len(x)
            out[k] = np.packbits(ones, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """(doc_id, fp binary): the fingerprint of each whole text, ``words`` little-endian 64-bit words."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = [fingerprint(shingle_hashes(t or b"", shingle), words).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary")


def _matrix(fps: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), "<u8").reshape(-1, words)


# ---------------------------------------------------------------- plan


def bit_statistics(nodes: DataFrame, words: int, more: int = 0) -> tuple[int, np.ndarray]:
    """(nodes, how often each two bits are both set), over all nodes; the driver gets one row for each bit. ``more`` words behind
    those of the fingerprint are not looked at."""
    size = 64 * words

    def count(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            fps = column(batch, "fp")
            for a in range(0, len(fps), 4096):
                held = np.ascontiguousarray(_matrix(fps[a : a + 4096], words + more)[:, :words])
                bits = np.unpackbits(held.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], names=["bit", "n", "row"]
        )

    def add(key, table):
        total = sum(np.frombuffer(r, np.float64) for r in column(table, "row"))
        return pa.table({"bit": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(column(table, "n"))], pa.int64()), "row": pa.array([total.tobytes()], pa.binary())})

    rows = nodes.select("fp").coalesce(STATISTICS_TASKS).mapInArrow(count, "bit int, n long, row binary").groupBy("bit").applyInArrow(add, "bit int, n long, row binary").collect()
    if not rows:
        return 0, np.zeros((size, size))
    rows.sort(key=lambda r: r["bit"])
    return int(rows[0]["n"]), np.array([np.frombuffer(bytes(r["row"]), np.float64) for r in rows])


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each starts at the free bit with the strongest ties and takes its closest ones."""
    size = len(together)
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = set(range(size)), []
    for k in range(parts):
        width = size // parts + (k < size % parts)
        at = sorted(free)
        group = [max(at, key=lambda b: (tie[b, at].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: tie[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(n: int, ones: np.ndarray, groups: list[list[int]], reach: int, most: int = 3) -> tuple[float, list[int]]:
    """(cost, threshold of each partition, -1 for none): the cheapest whose thresholds plus one add up to reach + 1."""
    p = ones / max(1, n)
    costs = []
    for bits in groups:
        near = np.zeros(most + 1)
        near[0] = 1
        for q in 2 * p[bits] * (1 - p[bits]):  # chance that two nodes differ in this bit
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        reachable = np.cumsum(near)
        costs.append([0.0] + [PROBE_COST * n * sum(comb(len(bits), k) for k in range(t + 1)) + CANDIDATE_COST * n * n / 2 * reachable[t] for t in range(most + 1)])
    need = reach + 1
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] + [(float("inf"), ())] * need]
    for cost in costs:
        row = []
        for have in range(need + 1):
            row.append(min((best[-1][max(0, have - take)][0] + c, best[-1][max(0, have - take)][1] + (take - 1,)) for take, c in enumerate(cost)))
        best.append(row)
    return best[-1][need][0], list(best[-1][need][1])


def plan(n: int, together: np.ndarray, reach: int, choices: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    options = []
    for parts in choices:
        groups = group_bits(n, together, parts)
        cost, thresholds = allocate(n, np.diag(together), groups, reach)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- probe and verify


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= (fps[:, b // 64] >> U64(b % 64) & U64(1)) << U64(j)
    return out


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << j for j in c) for k in range(1, most + 1) for c in combinations(range(width), k)]


def _key(part: int, value: np.ndarray) -> np.ndarray:
    return mix(value * U64(2) + U64(1) + U64((part + 1) << 50))


def local_components(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins the labels of a[i] and b[i] for all i."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not (label[label] == label).all():
            label = label[label]


def _forest(key, role, node, fps, near):
    """Labels of nodes after joining all pairs of a bucket whose differing bits are ``near``; role 0: node, 1: probe, 2: node of a block."""
    order = np.lexsort((role == 1, key))
    key, role, node = key[order], role[order], node[order]
    starts = runs(key)
    sizes = np.diff(np.r_[starts, len(key)])
    begin = np.repeat(starts, sizes)
    targets = np.repeat(np.add.reduceat((role != 1).astype(np.int64), starts), sizes)
    place = np.arange(len(key)) - begin
    # a node meets the nodes before it, a probe all nodes; in blocks nodes come as probes too
    count = np.where(role == 1, targets, np.where(role == 0, np.minimum(place, targets), 0))
    label = np.arange(len(fps))
    todo = np.flatnonzero(count)
    ends = np.cumsum(count[todo])
    at = 0
    while at < len(todo):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + STEP // fps.shape[1], side="right")))
        some = todo[at:to]
        c = count[some]
        left = np.repeat(some, c)
        right = np.repeat(begin[some] - (np.cumsum(c) - c), c) + np.arange(len(left))
        left, right = node[left], node[right]
        close = near(fps[left] ^ fps[right])
        if close.any():
            label = local_components(left[close], right[close], label)
        at = to
    return label


def links(nodes: DataFrame, reach: int, limit: int, choices: tuple[int, ...], words: int = 1, more: int = 0, also=None) -> DataFrame:
    """(u, v): edges that join all nodes (fp, node) within ``limit`` found in some partition; all pairs within ``reach`` are. ``fp`` may
    have ``more`` words behind the fingerprint; only pairs that ``also`` lets pass by their differing bits are joined then."""
    n, together = bit_statistics(nodes, words, more)
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    parts = plan(n, together, reach, choices)

    def own_keys(batch):
        fps = _matrix(column(batch, "fp"), words + more)
        return [_key(i, _values(fps, bits)) for i, (bits, _) in enumerate(parts)]

    def dealt(batch):
        fps, out = _matrix(column(batch, "fp"), words + more), []
        for i, (bits, t) in enumerate(parts):
            v = _values(fps, bits)
            out.append((_key(i, v), np.arange(len(v)), 0))
            for m in _masks(len(bits), t):
                up = np.flatnonzero((v ^ U64(m)) > v)  # the lower value probes the upper one
                out.append((_key(i, v[up] ^ U64(m)), up, 1))
        return out

    def near(differing):
        close = np.bitwise_count(differing[:, :words]).sum(axis=1) <= limit if words > 1 else np.bitwise_count(differing[:, 0]) <= limit
        if also is not None:
            at = np.flatnonzero(close)
            close[at] = also(differing[at, words:])
        return close

    entries = n * sum(1 + len(_masks(len(b), t)) // 2 for b, t in parts)
    return meet(nodes.select("fp", "node"), n, entries, words + more, own_keys, dealt, near)


def meet(nodes: DataFrame, n: int, entries: int, words: int, own_keys, dealt, near) -> DataFrame:
    """(u, v): edges that join the ``near`` nodes (fp, node, ...) of each bucket. ``own_keys`` gives a batch's bucket keys, one
    array for each kind of bucket, ``dealt`` its (key, node, role: 0 node, 1 probe)."""
    spark = nodes.sparkSession

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own_keys(batch)).view(np.int64), pa.int64())], names=["key"])

    # at most 10,000 for each partition can be so many
    hot_from = max(BLOCK, n // 10_000)
    hot = nodes.mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") > hot_from).collect()
    blocks = {int(np.int64(r["key"]).view(np.uint64)): -(-r["count"] // BLOCK) for r in hot}
    hot_keys = np.array(sorted(blocks), dtype=np.uint64)
    hot_blocks = np.array([blocks[int(k)] for k in hot_keys], dtype=np.int64)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries * (words + 2) // (4 << 20)))

    def send(batches):
        for batch in batches:
            rep = np.asarray(batch.column("node").to_numpy(), dtype=np.int64)
            fps = _matrix(column(batch, "fp"), words)
            out: list[tuple[np.ndarray, np.ndarray, int]] = dealt(batch)
            key = np.concatenate([k for k, _, _ in out])
            node = np.concatenate([x for _, x, _ in out])
            role = np.concatenate([np.full(len(k), r, dtype=np.int8) for k, _, r in out])
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                is_hot = hot_keys[at] == key
                hk, hn, hr, hb = key[is_hot], node[is_hot], role[is_hot], hot_blocks[at[is_hot]]
                key, node, role = [key[~is_hot]], [node[~is_hot]], [role[~is_hot]]
                own = (mix(fps[hn].sum(axis=1, dtype=np.uint64) + U64(5)) % hb.astype(np.uint64)).astype(np.int64)
                for k in range(int(hb.max(initial=0))):
                    has = k < hb
                    a = has & (hr == 0)
                    # as a node to block (own, k), as a probe to block (k, own)
                    key += [mix(hk[a] + U64(1) + (own[a] * 65536 + k).astype(np.uint64)), mix(hk[has] + U64(1) + (k * 65536 + own[has]).astype(np.uint64))]
                    node += [hn[a], hn[has]]
                    role += [np.full(a.sum(), 2, np.int8), np.full(has.sum(), 1, np.int8)]
                key, node, role = map(np.concatenate, (key, node, role))
            p = ((key >> U64(32)) * U64(tasks) >> U64(32)).astype(np.int64)
            ps, data = [], []
            for x, (k, r, nd) in split_by(p, [key, role, node]):
                ids, index = np.unique(nd, return_inverse=True)
                ps.append(x)
                data.append(freeze(k, r, index.astype(np.int32), rep[ids], fps[ids]))
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(data, pa.binary())], names=["p", "data"])

    def verify(key, table):
        ks, rs, ns, reps, fs, base = [], [], [], [], [], 0
        for k, r, index, rep, fps in map(thaw, column(table, "data")):
            ks.append(k)
            rs.append(r)
            ns.append(index.astype(np.int64) + base)
            reps.append(rep)
            fs.append(fps)
            base += len(rep)
        k, r, index, rep, fps = (np.concatenate(x) for x in (ks, rs, ns, reps, fs))
        label = _forest(k, r, index, fps, near)
        edge = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": pa.array(rep[edge], pa.int64()), "v": pa.array(rep[label[edge]], pa.int64())})

    return nodes.mapInArrow(send, "p long, data binary").groupBy("p").applyInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int, reach: int, limit: int | None = None, words: int = 1, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links within ``limit`` bits (``reach`` if not given) lead to."""
    marked = materialize(fingerprints(docs, shingle, words))
    nodes = materialize(numbered(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"))))
    member = least_ids(nodes, components(links(nodes, reach, limit or reach, choices, words))).select("fp", "component_id")
    known = marked.where("doc_id IS NOT NULL").join(member, "fp")
    return known.select("doc_id", "fp", "component_id").unionByName(marked.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
