"""JSON answers: every prefix of valid documents against the longest prefix that a closing bracket makes valid."""

from __future__ import annotations

import json
import random

from corpusmill.operators import answers as A

WHOLE = ['[{"a": 1, "b": [1, 2, {"c": "]}"}]}, "x\\"y", -1.5e3, true, null, {}]', '{"k": {"n": [1, [2]]}, "é\\u00e9": "a,b", "z": [ ], "t": false, "k": 7}', "[ 1 , 22 , 333 ]", '[[["deep"], 1], 2]', "{}", "[]"]


def closed(prefix):
    """The longest cut of a prefix that a closing bracket makes valid."""
    closer = "]" if prefix[0] == "[" else "}"
    for end in range(len(prefix), 0, -1):
        try:
            return json.loads(prefix[:end] + closer)
        except ValueError:
            continue
    return None


def test_every_prefix():
    for text in WHOLE:
        assert A.parsed(text) == ("whole", json.loads(text))
        for n in range(1, len(text)):
            want = closed(text[:n])
            status, value = A.parsed(text[:n])
            assert value == (want or None) and status == ("recovered" if want else "none"), text[:n]
            assert A.parsed(f"Here you are: {text[:n]}")[1] == (want or None)
        if len(text) > 2:
            assert A.parsed(f"```json\n{text}\n``` done") == ("found", json.loads(text))


def test_canonical_form_and_edges(spark):
    rng = random.Random(3)
    value = {"b": [1, {"z": None, "a": "é"}], "a": 1.5}
    for _ in range(20):
        keys = list(value)
        rng.shuffle(keys)
        assert A.canonical({k: value[k] for k in keys}) == '{"a":1.5,"b":[1,{"a":"\\u00e9","z":null}]}'
    long = "[" + ",".join('{"k": 1}' for _ in range(100_000)) + ',{"k'
    rows = [(1, '{"b": 1, "a": [2'), (2, None), (3, ""), (4, "no json"), (5, "[" * 100_000), (6, long), (7, "7"), (8, '{"a": 1 "b": 2}'), (9, "[1, 2}")]
    got = {r.i: (r.status, r.value) for r in A.answers(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got[1] == ("recovered", '{"b":1}') and got[2] == got[3] == got[4] == got[5] == ("none", None) and got[7] == ("whole", "7")
    assert got[6][0] == "recovered" and len(json.loads(got[6][1])) == 100_000 and got[8] == ("recovered", '{"a":1}') and got[9] == ("recovered", "[1,2]")
