"""Merges of two terms, their conflicts and digests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusmill.operators import merges as M

ROWS = f"i int, s {M.TERM}, t {M.TERM}, c map<string,string>, a map<string,struct<locale:string,auto_expand:boolean,search_enabled:boolean>>"


def term(name="Name", text="d", locale="en", kind="k", number=None, enabled=True, revision=3, version=5, aliases=()):
    return (name, text, locale, kind, number, enabled, revision, version, list(aliases))


def test_merge(spark):
    one, two = ("Al  Ias", "en", True, True), ("al ias", "de", True, True)
    rows = [
        (1, term(), term(), {}, {}),
        (2, term("Other", "x"), term(), {}, {}),
        (3, term("Other", "x"), term(), {"original_name": "source", "original_description": "target"}, {}),
        (4, term(text="new"), term(text=""), {}, {}),
        (5, term(aliases=[one, ("solo", None, False, True)]), term(aliases=[two]), {}, {}),
        (6, term(aliases=[one]), term(aliases=[two]), {}, {"al ias": ("fr", False, True)}),
        (7, term("Al Ias", aliases=[]), term("B", aliases=[one]), {"original_name": "source"}, {}),
        (8, term(number="0001"), term(number="0002"), {"infotype_number": "source"}, {}),
        (9, term(enabled=False), term(), None, None),
        (10, None, term(), {}, {}),
    ]
    got = {r.i: r for r in M.merged(spark.createDataFrame(rows, ROWS), "s", "t", "c", "a").collect()}
    assert got[1].unresolved == [] and got[1].merged.version == 6 and got[1].merged.source_revision == 3 and got[1].merged.aliases == []
    assert got[2].unresolved == ["original_name", "original_description"] and [a.alias for a in got[2].merged.aliases] == ["Other"]
    m = got[3].merged
    assert got[3].unresolved == [] and (m.original_name, m.original_description, m.source_revision) == ("Other", "d", 4) and [a.alias for a in m.aliases] == ["Name"]
    assert got[4].unresolved == [] and got[4].merged.original_description == "new" and got[4].merged.source_revision == 4
    assert got[5].unresolved == ["aliases[al ias]"] and [tuple(a) for a in got[5].merged.aliases] == [two, ("solo", None, False, True)]
    assert got[6].unresolved == [] and [tuple(a) for a in got[6].merged.aliases] == [("al ias", "fr", False, True)]
    assert got[7].unresolved == [] and [a.alias for a in got[7].merged.aliases] == ["B"]
    assert got[8].unresolved == ["infotype_number"] and got[9].unresolved == ["enabled"] and got[10].unresolved == []
    assert len({r.digest for r in got.values()}) == len(rows)


def test_digest_does_not_depend_on_order(spark):
    df = spark.createDataFrame([({"b": 'q"', "a": "é\n"}, {"a": "é\n", "b": 'q"'}, None)], "x map<string,string>, y map<string,string>, z map<string,string>")
    kind = df.schema["x"].dataType
    x, y, z = df.select(*[M.canonical(F.col(c), kind) for c in "xyz"]).first()
    assert x == y and z == "null" and json.loads(x) == {"a": "é\n", "b": 'q"'}
    left = spark.sql("SELECT named_struct('b', array(1, null), 'a', true) AS v")
    right = spark.sql("SELECT named_struct('a', true, 'b', array(1, null)) AS v")
    texts = [d.select(M.canonical(F.col("v"), d.schema["v"].dataType)).first()[0] for d in (left, right)]
    assert texts[0] == texts[1] and json.loads(texts[0]) == {"a": True, "b": [1, None]}
