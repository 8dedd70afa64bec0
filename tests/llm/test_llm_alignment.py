"""Alignment of two tokenizers against whole texts that are encoded at once."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from corpusmill.llm import alignment, queries

FILES = [open(f"{alignment.FOLDER}/{f}", "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*FILES)


def whole(pair, text):
    """(A ids, B ids, links, groups) of a text encoded in one piece."""
    if not text:
        return [], [], [], []
    want = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != want or b"".join(pair.bytes_b[i] for i in b) != want:
        return [], [], [], []
    ends = []
    for ids, held in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, out = 0, []
        for i in ids:
            at += len(held[i])
            out.append(at)
        ends.append(out)
    places = [{end: k + 1 for k, end in enumerate(e)} for e in ends]
    links, groups, i, j = [], [], 0, 0
    for end in sorted(places[0].keys() & places[1].keys()):
        x, y = places[0][end], places[1][end]
        links.append((a[x - 1], b[y - 1]))
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return a, b, links, groups


PARTS = [
    " ", "  ", "    ", "\n", "\r\n", "\n\n", "\t", "\x0b", "\x0c", "\r", " ", " ", "\x1c", "\x85", "　 ", "​", ";", "{", "}", ");", "'s", "'ll", "don't", "Hello", "world", "the",
    "42", "1234567", "...", "é", "naïve", "中文字", "🙂", "é", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "_", "▁", "a▁b", "\x00", "﻿", "ﬁ", "Ⅳ", "İ", "x" * 50, "#### ", "*/\r\n", "--",
]


def texts(n):
    rng = random.Random(11)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_cuts_are_read_from_the_vocabularies(pair):
    assert " " in pair.cuts and "\n" in pair.cuts and "\r" not in pair.cuts
    assert pair.segment.findall(" a;\r\nb c\n\n d  ") == [" a;\r\nb", " c", "\n\n d", "  "]


def test_segments_give_the_same_tokens_as_whole_texts(pair):
    for text in texts(6000):
        a, b, _, groups = whole(pair, text)
        assert pair.faithful(text) == bool(a)
        if a:
            segments = pair.segment.findall(" " + text)
            assert "".join(segments) == " " + text
            ids_a, ids_b = pair.encode(segments)
            assert sum(ids_a, []) == a and sum(ids_b, []) == b, repr(text)
            assert ";".join(alignment.align(segments, ids_a, ids_b, pair)[0]) == ";".join(groups)


def expected(pair, rows):
    found = [(i, whole(pair, t)) for i, t in rows]
    counts = Counter(link for _, w in found for link in w[2])
    best: dict = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for i, (a, b, links, groups) in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        yield (i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrstéö") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) + rng.choice(["", ".", "\n"]) for _ in range(150)]
    out = list(enumerate(texts(300) + prose))
    return out + [(900, None), (901, ""), (902, " "), (903, "\n"), (3, out[3][1]), (3, "other words"), (None, prose[0]), (None, None), (904, "x" * 30_000), (905, " ".join(words * 40)), (906, "a▁b and more")]


def test_query(spark, tmp_path, pair, rows):
    extra = ", ".join(f"{c} string" for c in ("groups", "block", "place", "segment", "n", "kind", "codes"))
    spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], f"doc_id long, text string, {extra}").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in got.dtypes[:7]} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == sorted(expected(pair, rows), key=KEY)


def test_small_blocks_and_few_places(spark, pair, rows):
    """Many blocks, and segments with more blocks than one row may list."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = alignment.tokens(docs, block=4000, most_places=3)
    want = sorted((r[:3] + r[4:7] for r in expected(pair, rows)), key=KEY)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=KEY) == want


def test_empty_table(spark):
    assert alignment.tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.tokens(docs).collect())) == [(1, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, "")]
