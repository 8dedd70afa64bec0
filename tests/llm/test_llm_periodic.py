"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import periodic, queries

WHITE = b" \t\n\x0b\x0c\r"


def brute(words: list) -> list[tuple[int, int, int]]:
    """All runs: for each period the longest stretches, each with its smallest period only."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = looped(doc_id, (text or "").encode().split())
    runs = brute(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def sample(rng: random.Random) -> list[int]:
    """Words of few kinds with stretches of all periods, whole and broken, and stretches within stretches."""
    kinds = rng.choice([1, 2, 3, 50])
    out = [rng.randrange(kinds) for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 65])
        unit = [rng.randrange(kinds) for _ in range(q)]
        if rng.random() < 0.3:
            unit = unit[: max(1, q // 4)] * 3 + unit
        piece = (unit * 9)[: rng.randint(2 * q, 7 * q)]
        if rng.random() < 0.3:
            piece[rng.randrange(len(piece))] = rng.randrange(kinds + 1)
        out += piece + [rng.randrange(kinds) for _ in range(rng.randrange(9))]
    return out


def test_all_runs_of_many_samples():
    rng = random.Random(13)
    for _ in range(1500):
        words = sample(rng)
        assert periodic.find(words) == brute(words), words
    assert any(len(brute(sample(rng))) > 1 for _ in range(50))


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.find(list(b)) == brute(list(b))
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    assert periodic.find(morse) == brute(morse) == []


def test_edges():
    assert periodic.find([1] * 23) == [] and periodic.find([1] * 24) == [(0, 24, 1)]
    assert periodic.find(list(range(9)) * 3) == [(0, 27, 9)] and periodic.find((list(range(9)) * 3)[:-1]) == []
    assert periodic.find([]) == [] and periodic.best([]) is None
    assert periodic.best([(5, 30, 10), (1, 24, 8), (1, 27, 9)]) == (1, 24, 8)
    with pytest.raises(ValueError):
        periodic.find([1] * 9, least=8)


def test_long_loops_stay_linear():
    assert periodic.find([1] * 400_000) == [(0, 400_000, 1)]
    words = list(range(40_000)) * 5
    assert periodic.find(words) == [(0, 200_000, 40_000)]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    word = lambda k: f"w{k}é"
    texts = [" ".join(map(word, sample(rng))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(300, None), (301, ""), (302, " \n\t"), (7, texts[7]), (7, "other"), (None, texts[9]), (None, None), (-5, "x " * 90), (303, "la la " * 50)]
    schema = "doc_id long, text string, runs string, best string, start string, h string"
    spark.createDataFrame([(i, t, "r", "b", "s", None) for i, t in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((expected(i, t) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 20


def test_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c " + "x y " * 20 + "z")], "doc_id long, text string")
    row = periodic.collapse(docs).first()
    assert row.collapsed == "a b c x y z" and row.runs[0].asDict() == {"start": 3, "length": 40, "period": 2} and row.n_words == 44
    assert periodic.collapse(docs.where(F.lit(False))).collect() == []
