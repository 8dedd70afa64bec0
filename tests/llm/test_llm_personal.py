"""Personal data: base spans against the patterns as they are stated, added spans against labels that no tree has seen."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import personal, queries

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def right(kind, said):
    d = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    return kind == "email" or (13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15)


def base(text):
    return [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, text or "") if right(k, m.group())]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PIECES = [
    "a", "b.c", "x_y", "@", "@", ".", "..", "-", "%", "+", "+", " ", " ", "  ", "\n", "é", "🙂", "(", ")", "1", "42", "255", "256", "300", "0", "00000012", "1.2.3.4", "10.0.0.255", "4465758382889437",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (279) 555-5103", "mail.example.com", "me@mail.example.com", "a@b.c", "\x01", "\x02", "\x03", "\x05", "tel ", "55", "0-0 0",
]


def long_texts(n):
    return ["x" * 2 * n + "@", "1" * n, "1 " * n, "a@b" + ".c" * n, "+1" + "(" * n, "+" * n, "1." * n, "a@b.cc " * n + "é", "4465758382889437\n" * (n // 10), "- " * n, "(1" * n, "1234 " * n, "ab:" * n, "x at y" * n]


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit(spark)


def test_base_spans(spark, tmp_path, model, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    long = long_texts(1000)
    rows = [(i, t) for i, t in enumerate(texts + long)] + [(3, texts[3]), (None, "me@a.bc"), (None, None), (-1, ""), (-2, None)]
    extra = "spans string, kind string, start string, x string, base string"
    spark.createDataFrame([(i, t, *["s"] * 5) for i, t in rows], f"doc_id long, text string, {extra}").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(personal, "fit", lambda spark: model)
    got = queries.op12_personal(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, t in rows:
        found = base(t)
        want.append((i, *[sum(k == x for x, _, _ in found) for k in STATED], hashlib.sha256(shown(found).encode()).hexdigest(), shown(found)))
    key = lambda r: tuple((x is None, x) for x in r)
    rows_got = sorted((tuple(r) for r in got.collect()), key=key)
    for g, w in zip(rows_got, sorted(want, key=key), strict=True):
        assert g[:6] == w[:6]
        more = [s for s in g[6].split(",") if s and s.split(":")[0] in personal.MORE_KINDS]
        assert ",".join([s for s in g[6].split(",") if s and s not in more]) == w[6]


def test_added_spans_on_unseen_snippets(spark, model):
    """Held-out snippets from another seed."""
    rows = personal.snippets(spark, 6000, seed=77)
    found = rows.select("kind", "private", "upto", personal.spans(F.col("text"), model).alias("spans")).collect()
    hit = lambda r: any(s["kind"] == r.kind and s["end"] == r.upto for s in r.spans)
    private, clean = [r for r in found if r.private], [r for r in found if not r.private]
    assert sum(map(hit, private)) >= 0.9 * len(private)
    assert sum(any(s["kind"] in personal.MORE_KINDS for s in r.spans) for r in clean) <= 0.03 * len(clean)
    for kind in personal.MORE_KINDS:
        own = [r for r in private if r.kind == kind]
        assert sum(map(hit, own)) >= 0.7 * len(own), kind
    assert all(0 < t <= 1 for t in model.thresholds.values())


def test_redact(spark, model):
    docs = spark.createDataFrame([(1, "mail é me@a.bc, now", "s"), (2, None, "s"), (3, "no data", "s"), (4, "+49 30 1234567 and 10.0.0.1", "s"), (5, "9.9.9.9", "s")], "doc_id int, text string, spans string")
    got = {r.doc_id: r.text for r in personal.redact(docs, model).collect()}
    assert got == {1: "mail é [PERSONAL], now", 2: None, 3: "no data", 4: "[PERSONAL] and [PERSONAL]", 5: "[PERSONAL]"}
    assert personal.redact(docs, model).columns == docs.columns


def test_clean_prose_has_no_spans(spark, model):
    prose = ["In 2019 it rose by 3.5 % to 1,200,000 at home.", "See pages 120-125, version 2.10.3, at 12:30:45 on 2024-01-02.", "Order 555 1234 of 12 34 56; room 101.", "Total 12 000 000.50 and 1 234 567."]
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id int, text string")
    assert all(not r.spans for r in personal.scan(docs, model).collect())


def test_very_long_texts(spark, model):
    docs = spark.createDataFrame(list(enumerate(long_texts(60_000))), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r.n for r in personal.scan(docs, model).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[7] == 60_000 and got[8] == 6_000 and got[1] == 0


def test_thresholds_and_empty_table(spark, model):
    assert personal.threshold([(0.9, 1), (0.8, 1), (0.7, 0), (0.7, 1), (0.2, 0)], 0.75) == pytest.approx(0.7)
    assert personal.threshold([(0.9, 0)], 0.9) > 1 and personal.threshold([], 0.9) > 1
    assert personal.scan(spark.createDataFrame([], "doc_id int, text string"), model).collect() == []
