"""The pipeline's stages on planted cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from corpusmill.llm import graph, mixing, simhash, similar

ITEM = "what is the tall zebra said to carry over the frozen river at night answer eleven copper lanterns"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(9)) + "." for _ in range(n // 9))
    rows = [(i, prose(200), "en", f"s{i % 4}") for i in range(40)]
    near = rows[0][1].split()
    near[60] = "changed"
    rows += [(40, rows[1][1], "en", "s1"), (41, " ".join(near), "en", "s2"), (42, prose(100) + " " + ITEM + ". " + prose(100), "en", "s3")]
    rows += [(43, prose(90) + ' token = "0123456789abcdef0123" ' + prose(90), "en", None), (44, None, None, None), (45, "", "en", "s1")]
    rows += [(46, " ".join(f"{word()}###" for _ in range(100)), "en", "s1"), (47, rows[1][1], "en", "s1")]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = []
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, planted))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(40))
    assert kept[0] == clean | {40, 41, 42, 43, 47}
    assert kept[1] == clean | {42, 43}
    assert kept[2] == kept[3] == clean | {43}
    assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all("0123456789abcdef" not in r.text for r in docs.collect())


def test_run_and_empty_input(spark, planted, tmp_path):
    assert P.run(spark, planted).count() > 0
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    rows: list[tuple[int | None, str | None]] = []
    for _ in range(60):  # edits that leave similarities on both sides of 0.8, in short and in long texts
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 13, 40, 120, 400]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40 + (len(words) < 40))):
                copy[rng.choice([0, -1, rng.randrange(len(copy))])] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert sum(0.7 <= s < 0.8 for s in similar.values()) > 15 and sum(0.8 <= s < 0.9 for s in similar.values()) > 15
    for _ in range(len(sets)):
        for a, b in (p for p, s in similar.items() if s >= 0.8):
            least[a] = least[b] = min(least[a], least[b])
    rows += [(None, rows[0][1]), (1000, None), (1001, ""), (1002, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in least if least[i] == i} | {None, 1000}


def test_fingerprints_find_all_pairs_within_their_reach(spark):
    """The SimHash search before the bands add the rest, on pairs with a few changed words."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(words)
        for at in rng.sample(range(10, 290), rng.randrange(1, 7)):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    nodes = similar._signed(spark.createDataFrame(rows, "doc_id long, text string"), 5).withColumnRenamed("doc_id", "node")
    found = simhash.links(nodes.selectExpr("bits AS fp", "node"), similar.REACH, similar.MOST_BITS, similar.PARTS, similar.WORDS)
    got = {tuple(sorted((r.u, r.v))) for r in found.collect()}
    bits = {r.node: int.from_bytes(r.bits, "little") for r in nodes.collect()}
    near = {(k, k + 1) for k in range(0, 300, 2) if (bits[k] ^ bits[k + 1]).bit_count() <= similar.REACH}
    assert len(near) > 50 and near <= got and all((bits[u] ^ bits[v]).bit_count() <= similar.MOST_BITS for u, v in got)


def test_no_text_is_lost_to_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    schema = "doc_id long, text string, source string, same string, kept long, _dup_same string"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (9, c), (9, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "s", "x", 1, "y") for i, t in rows], schema)
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, a), (5, b), (9, c), (0, a), (0, a)])


def test_mixing_takes_equal_rows_together(spark):
    rng = random.Random(4)
    rows = [(i % 50, " ".join(["w"] * rng.choice([5, 5, 9])), f"s{i % 2}") for i in range(400)] + [(None, "w w", None)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.copies
    out = P.mix(spark, docs, "").collect()
    assert Counter(r.source for r in out) == taken and {r.copy for r in out} <= {1, 2}


def test_stages_keep_columns_of_any_name(spark, planted):
    names = (
        "_t _w _l n_words kept clean_text word_chars _dup_id _dup_hash row same copy _copy _at _id _src _n _rows id src n rows at times no_id no_src copies"
        " size source_size _s _p place _sieve_word _sieve_bits _sieve_hash component_id fp node h spans score item_id"
    ).split()
    docs = spark.read.parquet(f"{planted}/documents.parquet").selectExpr("*", *[f"concat('mine ', doc_id, ' {c}') AS `{c}`" for c in names])
    for name, stage in P.STAGES:
        out = stage(spark, docs, planted)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.columns[len(docs.columns) :] == (["__copy"] if stage is P.mix else []), name
        for r in out.collect():
            assert all(r[c] == f"mine {r.doc_id} {c}" for c in names), name


def test_near_fingerprints_of_unlike_texts_do_not_meet(spark):
    rng = np.random.default_rng(5)
    bands = lambda k: rng.integers(0, 1 << 62, similar.BANDS, dtype=np.uint64).tobytes()
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    alike = rng.integers(0, 256, similar.MINIMA, dtype=np.uint8)
    rows = []
    for k in range(60):  # all within two bits of each other; the first 20 share most of their minima
        fp = rng.integers(0, 256, similar.MINIMA, dtype=np.uint8) if k >= 20 else np.where(rng.random(similar.MINIMA) < 0.9, alike, 0).astype(np.uint8)
        rows.append((k, (base ^ (np.uint64(1) << np.uint64(k))).tobytes(), fp.tobytes(), bands(k)))
    nodes = spark.createDataFrame(rows, "node long, bits binary, fp binary, bands binary")
    got = graph.components(similar.candidates(nodes)).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(1, 20)}


def test_sets_of_large_groups_are_sent_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(30)] + [None, "one"]
    digests = [similar.xxhash.xxh128_digest(similar.shingle_set(t and t.encode(), 5).tobytes()) for t in texts]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"node": list(range(n)), "digest": digests, "component": [3] * n, "blocks": [50] * (n - 1) + [1], "text": texts})
    monkeypatch.setattr(similar, "SENT", 5000)
    got = list(similar.sent(iter([batch, batch.slice(0, 0)]), 5, 7))
    assert max(sum(map(len, b.column("data").to_pylist())) for b in got) <= 5000
    monkeypatch.setattr(similar, "SENT", 1 << 30)
    whole = list(similar.sent(iter([batch]), 5, 7))
    rows = lambda bs: [r for b in bs for r in zip(*[b.column(c).to_pylist() for c in b.schema.names], strict=True)]
    assert len(whole) == 1 and rows(got) == rows(whole) and len(rows(got)) == 49 * (n - 1) + 1
