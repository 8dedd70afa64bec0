"""Near duplicates by SimHash, decided by the Jaccard similarity of shingle sets.

SimHash finds candidates by the generalised pigeonhole principle: all pairs within REACH bits, and many up to MOST_BITS, of which those
with too few equal minima for a similarity of 0.8 part again.
Pairs of similarity 0.8 differ in 10 of 64 bits on average, more than can be probed for, so bands of MinHash values find
what lies beyond the reach: texts that share all minima of a band meet, and those with too few equal minima in all part
again. Neither search depends on the number of texts. Candidates are only joined to groups that may hold near
duplicates; within a group the shingle sets themselves are compared, every pair that is not linked already, and those links
decide.

Texts with equal sets are one node. Null texts are empty; texts without words are one node. Rows with a null doc_id get no
component. Rows of one doc_id with different texts are judged each by its own set; ``same`` tells them apart. Repeated rows
get equal results, an empty table an empty one; further columns are ignored.

Texts of candidates are fetched by a merge join at every size, so the plan does not change with the input; texts that a sieve of
fixed size shows to be no candidate's are not moved for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sieved
from .graph import components, least_ids, numbered
from .repeats import U64, column, mix, runs
from .simhash import fingerprint, links, meet, shingle_hashes

#: 64-bit words of a fingerprint, its partitions, the distance within which all pairs are found, and the most that a candidate has:
#: 0.8 is 10 bits with a deviation of 3.
WORDS, PARTS, REACH, MOST_BITS = 1, (3,), 5, 16
#: A pair of similarity s shares no band in (1 - s ** ROWS) ** BANDS of all cases, 0.8 in 0.0003 %.
BANDS, ROWS = 24, 4
MINIMA = BANDS * ROWS
#: So many minima of a candidate pair are equal; at 0.8 they are 77 on average, and fewer than this in 0.00004 % of all cases.
LEAST_EQUAL = 56
#: Near fingerprints of unlike texts grow squared with the texts, and would in the end join all of them to one group. Of the first SKETCH
#: minima such a pair shares SKETCH_EQUAL bytes in 0.003 % of all cases; a pair of similarity 0.8 shares fewer in 0.000001 %.
SKETCH, SKETCH_EQUAL = 16, 3
#: A group with more nodes or shingles is compared in blocks of about so many by several tasks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Bytes of shingle sets that a task holds before it hands them on.
SENT = 8 << 20
#: Shingles that one task compares.
TASK_SHINGLES = 2 << 20
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64) * U64(2) + U64(1)
_PLACE = np.arange(1, BANDS + 1, dtype=np.uint64) << U64(48)


def same() -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", size))


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of the set under each of MINIMA orders."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 2048):
        best = np.minimum(best, ((h[k : k + 2048] ^ _FLIP) * _TIMES).min(axis=1))
    return best


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, same: a hash of the text, digest of the set, bits: its fingerprint, fp: a byte of each minimum, bands: a hash of each band, size of the set)."""

    def run(batches):
        for batch in batches:
            digests, bits, fps, bands, sizes = [], [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                h = shingle_set(t, shingle)
                m = mix(minima(h))
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                bits.append(fingerprint(h, WORDS).tobytes())
                fps.append((m >> U64(56)).astype(np.uint8).tobytes())
                bands.append(mix((m.reshape(BANDS, ROWS) * U64(0x9E3779B97F4A7C15) ** np.arange(1, ROWS + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + _PLACE).tobytes())
                sizes.append(len(h))
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("same"), *[pa.array(x, pa.binary()) for x in (digests, bits, fps, bands)], pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "digest", "bits", "fp", "bands", "size"])

    return docs.select("doc_id", "text", same().alias("same")).mapInArrow(run, "doc_id long, same long, digest binary, bits binary, fp binary, bands binary, size long")


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that join all nodes (node, bits, fp, bands) whose fingerprints or minima are near."""
    return by_bits(nodes).unionByName(by_bands(nodes))


def by_bits(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that join all nodes (node, bits, fp) with near fingerprints and SKETCH_EQUAL equal minima among the first ones."""

    def alike(differing):
        return (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, SKETCH) == 0).sum(axis=1) >= SKETCH_EQUAL

    drawn = nodes.select("node", F.concat("bits", F.substring("fp", 1, SKETCH)).alias("fp"))
    return links(drawn, REACH, MOST_BITS, PARTS, WORDS, SKETCH // 8, alike)


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(node, fp, keys) for the nodes (node, fp, bands) that share a band, with the keys of the bands that they share."""

    def each(batches):
        for batch in batches:
            key = np.frombuffer(b"".join(column(batch, "bands")), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS), pa.int64()), pa.array(key, pa.int64())], names=["node", "key"])

    keys = nodes.select("node", "bands").mapInArrow(each, "node long, key long")
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    own = keys.join(met.hint("merge"), "key").groupBy("node").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    return nodes.select("node", "fp").join(own.hint("merge"), "node")


def by_bands(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that join all nodes (fp, node, bands) that share a band and LEAST_EQUAL minima. Only what shares a band sends its
    minima, and only to the bands that it shares."""

    def own_keys(batch):
        return [batch.column("keys").flatten().to_numpy().view(np.uint64)]

    def dealt(batch):
        n = batch.column("keys").value_lengths().to_numpy()
        return [(own_keys(batch)[0], np.repeat(np.arange(len(n)), n), 0)]

    def near(differing):
        return (differing.view(np.uint8).reshape(-1, MINIMA) == 0).sum(axis=1) >= LEAST_EQUAL

    found = materialize(shared_bands(nodes))
    entries = int(found.agg(F.sum(F.size("keys"))).first()[0] or 0)
    return meet(found, nodes.count(), entries, MINIMA // 8, own_keys, dealt, near)


def linked(sets: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """Labels of sets after joining all pairs with a similarity of least[0] / least[1] or more."""
    n, (over, under) = len(sets), least
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.arange(n)
    for i in range(n - 1):
        if (label == label[i]).all():
            break
        has = np.zeros(len(names), dtype=np.int64)
        has[flat[starts[i] : starts[i] + sizes[i]]] = 1
        # only the sets behind i
        both = np.add.reduceat(has[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        near = i + 1 + np.flatnonzero(both * under >= (sizes[i] + sizes[i + 1 :] - both) * over)
        if len(near):
            old = np.unique(label[np.r_[i, near]])
            label[np.isin(label, old)] = old[0]
    return label


def sent(batches, shingle: int, tasks: int):
    """Record batches (p, g, rep, data) of the shingle sets of members (node, digest, component, blocks, text), each once for every pair of
    blocks that it is in. None has more than SENT bytes of sets, or one set, however many blocks a group has."""

    def handed():
        columns = [pa.array(np.concatenate(ps).view(np.int64)), pa.array(np.concatenate(gs).view(np.int64)), pa.array(reps, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["p", "g", "rep", "data"])

    for batch in batches:
        rows = zip(*(column(batch, c) for c in ("node", "digest", "component", "blocks")), batch.column("text").cast(pa.binary()), strict=True)
        ps, gs, reps, data, held = [], [], [], [], 0
        seen = set()
        for node, digest, component, blocks, text in rows:
            if node in seen:  # a repeated row
                continue
            seen.add(node)
            h = shingle_set(text.as_py(), shingle)
            frame = h.tobytes()
            if xxhash.xxh128_digest(frame) != digest:  # another text of the same doc_id and hash
                continue
            own = int(mix(np.array([node], dtype=np.int64).view(np.uint64))[0] % U64(blocks))
            other = np.array([k for k in range(blocks) if k != own or blocks == 1], dtype=np.uint64)
            pair = np.minimum(other, U64(own)) * U64(1 << 24) + np.maximum(other, U64(own))
            every = mix(mix(np.array([component], dtype=np.int64).view(np.uint64)) + pair)
            step = max(1, SENT // max(1, len(frame)))
            for k in range(0, len(every), step):
                g = every[k : k + step]
                if data and held + len(g) * len(frame) > SENT:
                    yield handed()
                    ps, gs, reps, data, held = [], [], [], [], 0
                gs.append(g)
                ps.append(g % U64(tasks))
                reps += [node] * len(g)
                data += [frame] * len(g)
                held += len(g) * len(frame)
        if data:
            yield handed()


def _verified(docs: DataFrame, members: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(u, v): edges that join all members (node, rep, digest, component, size) of a group whose sets are near enough."""
    groups = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    members = materialize(members.join(groups.select("component", blocks), "component"))
    total = int(members.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SHINGLES))

    def send(batches):
        yield from sent(batches, shingle, tasks)

    def verify(key, table):
        g, rep, data = table.column("g").to_numpy(), table.column("rep").to_numpy(), column(table, "data")
        order = np.argsort(g, kind="stable")
        starts = runs(g[order])
        u, v = [], []
        for a, b in zip(starts, np.r_[starts[1:], len(g)], strict=True):
            at = order[a:b]
            at = at[np.unique(rep[at], return_index=True)[1]]
            label = linked([np.frombuffer(data[k], "<u8") for k in at], least)
            edge = np.flatnonzero(label != np.arange(len(label)))
            u.append(rep[at[edge]])
            v.append(rep[at[label[edge]]])
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    wanted = members.select("node", "digest", "component", "blocks", F.col("rep").alias("doc_id"), "same").hint("merge")
    maybe, _ = sieved(docs.select("doc_id", "text"), wanted, "doc_id")
    texts = maybe.select("doc_id", "text", same().alias("same")).join(wanted, ["doc_id", "same"])
    texts = texts.select("node", "digest", "component", "blocks", "text")
    return texts.mapInArrow(send, "p long, g long, rep long, data binary").groupBy("p").applyInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, same, component_id, kept): the smallest doc_id that links of a similarity of least[0] / least[1] or more lead
    to, and whether the row is the one of its group that stays (its equals, if any, have the same mark)."""
    marked = materialize(_signed(docs, shingle))
    known = marked.where("doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("bits", "fp", "bands", "size")]
    least_row = F.min(F.struct("doc_id", "same")).alias("row")
    nodes = known.groupBy("digest").agg(least_row, *first)
    nodes = materialize(numbered(nodes.select("digest", F.col("row.doc_id").alias("rep"), F.col("row.same").alias("same"), "bits", "fp", "bands", "size")))
    maybe = components(candidates(nodes.where("size > 0")))
    maybe = materialize(maybe.unionByName(maybe.select(F.col("component").alias("node"), "component").distinct()))
    members = nodes.select("node", "digest", "rep", "same", "size").join(maybe, "node").where("size > 0")
    found = components(_verified(docs, members, shingle, least))
    placed = least_ids(nodes.select("node", "digest", "rep", "same"), found)
    chosen = placed.groupBy("component").agg(F.min(F.struct("rep", "same")).alias("row"))
    chosen = chosen.select("component", F.col("row.rep").alias("component_id"), F.col("row.same").alias("chosen"))
    member = materialize(placed.select("digest", "component").join(chosen, "component").drop("component"))
    out = known.join(member, "digest").select("doc_id", "same", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("same") == F.col("chosen"))).alias("kept"))
    return out.unionByName(marked.where("doc_id IS NULL").select("doc_id", "same", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
