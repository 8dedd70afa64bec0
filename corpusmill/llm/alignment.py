"""Alignment of two tokenizers by distinct segments: each segment is tokenised and aligned once, documents are composed from them.

A is a byte-level BPE, B a BPE of pieces with byte fallback. A text, with a space in front, is cut before runs of white space whose first
character no entry of either vocabulary holds behind another character that is no white space, so no merge of either can cross
the cut (``safe_cuts`` reads this from the vocabularies and the settings; what can't be shown isn't cut). Then:

1. Tasks pack documents into blocks of about BLOCK characters: the block's distinct segments with their counts, and its documents as
   numbers of them. Both are written to the shared folder.
2. Segments meet across blocks by shuffling, with the places where they belong; each is tokenised and aligned once, for each
   MOST_PLACES blocks of the corpus at most, so that no row lists more places than that.
3. How often an A id and a B id are linked is summed over the segments. Linked tokens end together, so the shorter is a suffix of
   the longer and there are at most as many pairs as the two vocabularies have bytes; that table is broadcast.
4. The alignments go back to their blocks, in order, in front of the block's documents, which are composed one by one.

Null and empty texts, and those whose tokens don't give back the text (they hold U+2581, which B reads as a space), have no tokens: all
their counts are zero and ``groups`` is ''. They add no links. Repeated rows and ids count each; an empty table gives an empty one. A text
of any length is aligned whole and makes a block of its own if it is long; a long stretch without white space is one segment. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_dir

FOLDER = "/opt/tokenizers"
#: Characters of a block, and blocks whose places one row may list.
BLOCK, MOST_PLACES = 16_000_000, 4096
#: Larger files are refused, as they are broadcast.
MOST_BYTES = 64_000_000
SPACE = "▁"
WHITE = " \t\n\x0b\x0c\r"


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of byte-level entries stand for: printable Latin-1 is itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and the characters before which texts may be cut."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte_of = _byte_of()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in e], dtype=np.int64) for e in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(SPACE)
        self.cuts = safe_cuts(a, b, self.bytes_a, [p for i, p in enumerate(pieces) if not self.b.is_byte(i)])
        held = f"(?:(?![{re.escape(self.cuts)}])\\s+\\S*)*" if self.cuts else "[\\s\\S]*"
        self.segment = re.compile(f"\\s*\\S+{held}|\\s+")

    def faithful(self, text: str) -> bool:
        """Whether B's pieces give back the text; A's bytes always do."""
        return SPACE not in text and self.b.normalize(text).replace(SPACE, " ") == " " + text

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments, each with its own white space in front: B puts a space before what it reads, which takes the
        place of a segment's first space and is dropped before other white space."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        b = [[self.space] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, b, strict=True)]
        return a, b


def safe_cuts(a: bytes, b: bytes, bytes_a: list[bytes], pieces: list[str]) -> str:
    """White space characters before which both tokenizers can be run apart, if they stand first in a run of white space.

    A cuts texts by a pattern none of whose parts holds white space behind anything else. B merges neighbours into pieces of its
    vocabulary only, so no merge crosses a place that no piece has inside; what it merges is not changed before. Raises for a
    vocabulary that can't write all bytes.
    """
    from sentencepiece import sentencepiece_model_pb2 as protos

    model = protos.ModelProto.FromString(b)
    if not {bytes([i]) for i in range(256)} <= set(bytes_a) or not model.trainer_spec.byte_fallback:
        raise ValueError("a vocabulary can't write all bytes")
    config, norm, bpe = json.loads(a), model.normalizer_spec, model.trainer_spec.model_type == protos.TrainerSpec.BPE
    pre = config.get("pre_tokenizer") or {}
    shown = (
        config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and bpe and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in model.pieces)
    )
    if not shown:
        return ""
    texts_a = [x.decode("utf-8", "replace") for x in bytes_a]  # parts of characters count as no white space

    def inside(c: str) -> bool:
        """Whether an entry holds c behind a character that is no white space, or, for B's added space to come off, behind a space."""
        own = SPACE if c == " " else c
        behind_a = re.compile(r"\S" + re.escape(c))
        behind_b = re.compile(f"[^{SPACE}\\s]{own}" + ("" if c == " " else f"|{SPACE}{own}"))
        return any(behind_a.search(x) for x in texts_a) or any(behind_b.search(p) for p in pieces)

    return "".join(c for c in WHITE if not inside(c))


_pairs: dict[str, Pair] = {}


def _loaded(files) -> Pair:
    """The tokenizers of this worker, made once."""
    a, b, digest = files.value
    if digest not in _pairs:
        _pairs[digest] = Pair(a, b)
    return _pairs[digest]


def align(segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]], pair: Pair) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(groups of each segment as text, links of each segment, A ids and B ids of all links in order)."""
    flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64) for x in (ids_a, ids_b))
    end_a, end_b = np.cumsum(pair.len_a[flat_a]), np.cumsum(pair.len_b[flat_b])
    stop = np.cumsum([len(s.encode("utf-8")) for s in segments])
    last_a, last_b = (np.cumsum([len(x) for x in y]) for y in (ids_a, ids_b))
    if (end_a[last_a - 1] != stop).any() or (end_b[last_b - 1] != stop).any():
        raise ValueError("tokens don't give back their segment")
    at_a, at_b = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True)), np.flatnonzero(np.isin(end_b, end_a, assume_unique=True))
    text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    groups, i, j = [], 0, 0
    for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
        groups.append(f"{text_a[i]}|{text_b[j]}" if x - i == 1 == y - j else ",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y]))
        i, j = x, y
    upto = np.searchsorted(end_a[at_a], stop, side="right")
    n = np.diff(upto, prepend=0)
    k = upto.tolist()
    return [";".join(groups[x:y]) for x, y in zip([0, *k], k, strict=False)], n, flat_a[at_a], flat_b[at_b]


def _pack(docs: DataFrame, files, size: int) -> DataFrame:
    """Rows of two kinds: the distinct segments of blocks, and the documents of blocks (ids and sizes as an Arrow stream) as numbers of them."""
    import zstandard

    fields = [
        ("kind", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("segment", pa.string()), ("n", pa.int64()),
        ("docs", pa.binary()), ("codes", pa.binary()),
    ]
    form = pa.schema(fields)

    def rows(kind, size, **columns):
        given = {"kind": pa.array([kind] * size), **columns}
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(size, t)) for k, t in fields], schema=form)

    def run(batches):
        pair, base, held = _loaded(files), TaskContext.get().partitionId() << 24, 0
        numbers: dict[str, int] = {}
        ids, sizes, codes = [], [], []

        def block():
            key = base + held
            flat = np.concatenate(codes) if codes else np.empty(0, dtype=np.int32)
            n = pa.array(np.bincount(flat, minlength=len(numbers)).astype(np.int64))
            segments = pa.array(list(numbers), pa.string())
            for at in range(0, len(numbers), 20_000):
                part = min(20_000, len(numbers) - at)
                yield rows("segments", part, block=pa.array([key] * part, pa.int64()), place=pa.array(range(at, at + part), pa.int32()), segment=segments.slice(at, part), n=n.slice(at, part))
            packed = zstandard.ZstdCompressor(level=3).compress(flat.astype("<i4").tobytes())
            table = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "size"])
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_batch(table)
                yield rows("texts", 1, block=pa.array([key], pa.int64()), docs=pa.array([sink.getvalue().to_pybytes()], pa.binary()), codes=pa.array([packed], pa.binary()))

        chars = 0
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            for doc, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc)
                if text and pair.faithful(text):
                    own = np.array([numbers.setdefault(s, len(numbers)) for s in pair.segment.findall(" " + text)], dtype=np.int32)
                    codes.append(own)
                    sizes.append(len(own))
                else:
                    sizes.append(0)
                chars += len(text or "") + 8
                if chars >= size:
                    yield from block()
                    held, chars, numbers, ids, sizes, codes = held + 1, 0, {}, [], [], []
                    pa.default_memory_pool().release_unused()
        if ids:
            yield from block()

    schema = "kind string, block long, place int, segment string, n long, docs binary, codes binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


_ALIGNED = "n long, places array<struct<block:long,place:int>>, groups string, n_a int, n_b int, links_a array<int>, links_b array<int>"


def _aligned(segments: DataFrame, files) -> DataFrame:
    def run(batches):
        pair = _loaded(files)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("segment").to_pylist()
            ids_a, ids_b = pair.encode(texts)
            groups, n, a, b = align(texts, ids_a, ids_b, pair)
            upto = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(upto, pa.array(x.astype(np.int32))) for x in (a, b)]
            counts = [pa.array([len(x) for x in ids], pa.int32()) for ids in (ids_a, ids_b)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("places"), pa.array(groups), *counts, *lists], names=["n", "places", "groups", "n_a", "n_b", "links_a", "links_b"])

    return segments.select("segment", "n", "places").mapInArrow(run, _ALIGNED)


def _scored(aligned: DataFrame, links) -> DataFrame:
    """Adds n_best and count_sum to the alignments, from the counts of all pairs."""

    def run(batches):
        width, keys, counts, best = links.value
        for batch in batches:
            a, b = batch.column("links_a"), batch.column("links_b")
            at = np.searchsorted(keys, a.flatten().to_numpy().astype(np.int64) * width + b.flatten().to_numpy())
            n = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], np.cumsum(n)])]) for x in (best.astype(np.int64), counts)]
            columns = [batch.column(c) for c in ("places", "groups", "n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int32)), *map(pa.array, sums)], names=["places", "groups", "n_a", "n_b", "n_links", "n_best", "count_sum"])

    schema = "places array<struct<block:long,place:int>>, groups string, n_a int, n_b int, n_links int, n_best long, count_sum long"
    return aligned.select("places", "groups", "n_a", "n_b", "links_a", "links_b").mapInArrow(run, schema)


COUNTS = ("n_a", "n_b", "n_links", "n_best", "count_sum")


def _compose(rows: DataFrame) -> DataFrame:
    """Documents from rows by block: the alignments by place, then the documents as their numbers. No column is a list: Spark's
    Arrow writer goes back over all empty lists of a batch for each row."""
    import zstandard

    def run(batches):
        groups, numbers, of = [], {c: [] for c in COUNTS}, None

        def documents(docs, codes):
            ids, sizes = (c.to_pylist() for c in pa.ipc.open_stream(docs).read_all().columns)
            flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), dtype="<i4")
            table = {c: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for c, v in numbers.items()}
            at, out = 0, []
            for doc, size in zip(ids, sizes, strict=True):
                own = flat[at : at + size]
                at += size
                out.append((doc, *[int(table[c][own].sum()) for c in COUNTS], ";".join([groups[k] for k in own.tolist()])))
                if len(out) == 500:
                    yield out
                    out = []
            if out:
                yield out

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for x, y in itertools.pairwise(edges):
                part = batch.slice(x, y - x)
                if of != blocks[x]:
                    groups, numbers, of = [], {c: [] for c in COUNTS}, blocks[x]
                ends = part.column("codes").is_valid().to_pylist()
                n = ends.index(True) if True in ends else len(ends)
                groups += part.column("groups").slice(0, n).to_pylist()
                for c in COUNTS:
                    numbers[c].append(part.column(c).slice(0, n).to_numpy(zero_copy_only=False))
                if n < len(ends):
                    last = part.slice(n, 1).to_pylist()[0]
                    for out in documents(last["docs"], last["codes"]):
                        ids, *counts, texts = zip(*out, strict=True)
                        columns = [pa.array(x, pa.int64()) for x in (ids, *counts)] + [pa.array(texts, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "groups"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string")


def tokens(docs: DataFrame, a: str = f"{FOLDER}/byte_bpe_50k.json", b: str = f"{FOLDER}/piece_bpe_32k.model", block: int = BLOCK, most_places: int = MOST_PLACES) -> DataFrame:
    """(doc_id, n_a, n_b, n_links, n_best, count_sum, groups) for each row: tokens of both, links (A and B tokens that end together),
    those whose ids are linked as often as any with that B id, the links' counts over the corpus summed, and the groups of A ids and
    B ids between links as ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    raw = []
    for path in (a, b):
        with open(path, "rb") as f:
            raw.append(f.read())
    if sum(map(len, raw)) > MOST_BYTES:
        raise ValueError(f"{a} and {b} are too large to be broadcast")
    files = spark.sparkContext.broadcast((*raw, hashlib.sha1(b"".join(raw)).hexdigest()))
    width = len(Pair(*raw).len_b)
    folder = work_dir(spark)
    packed = _pack(docs, files, block)
    packed.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/packed")
    held = spark.read.schema(packed.schema).parquet(f"{folder}/packed")
    texts = held.where("kind = 'texts'").select("block", "docs", "codes")
    blocks = texts.count()
    part = F.pmod(F.xxhash64("block"), F.lit(-(-blocks // most_places) or 1))
    segments = held.where("kind = 'segments'").groupBy("segment", part.alias("part")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "place")).alias("places"))
    _aligned(segments, files).write.option("compression", "zstd").parquet(f"{folder}/aligned")
    aligned = spark.read.schema(_ALIGNED).parquet(f"{folder}/aligned")
    link = F.explode(F.arrays_zip("links_a", "links_b")).alias("link")
    pairs = aligned.select("n", link).groupBy("link.links_a", "link.links_b").agg(F.sum("n").alias("n")).toArrow()
    pair_a, pair_b, n = (pairs.column(c).to_numpy().astype(np.int64) for c in ("links_a", "links_b", "n"))
    order = np.argsort(pair_a * width + pair_b)
    pair_a, pair_b, n = pair_a[order], pair_b[order], n[order]
    highest = np.zeros(width, dtype=np.int64)
    np.maximum.at(highest, pair_b, n)
    links = spark.sparkContext.broadcast((width, pair_a * width + pair_b, n, n == highest[pair_b]))
    back = _scored(aligned, links).select(F.explode("places").alias("to"), "groups", *COUNTS).select("to.block", "to.place", "groups", *COUNTS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 2)
    rows = back.unionByName(texts, allowMissingColumns=True).repartition(parts, "block")
    return _compose(rows.sortWithinPartitions("block", F.col("place").asc_nulls_last()))
