"""Stacked tables: sheets made by hand, and random ones against a plain walk over rows."""

from __future__ import annotations

import random

from corpusmill.operators.regions import stacked

CELLS = "s int, row int, col int, text string, kind string, formula boolean, bold boolean"
BOX = "top int, left int, bottom int, right int"


def run(spark, areas, cells, merges):
    got = stacked(spark.createDataFrame(areas, f"a int, s int, {BOX}"), spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, f"s int, {BOX}"), "a", "s")
    return sorted(tuple(r) for r in got.select("a", "top", "left", "bottom", "right").collect())


def walk(area, cells, merges):
    """The tables of one area, row after row."""
    a, s, top, left, bottom, right = area
    own = [c for c in cells if c[0] == s and top <= c[1] <= bottom and left <= c[2] <= right]
    rows = {}
    for c in sorted(own, key=lambda c: (c[1], c[2])):
        rows.setdefault(c[1], []).append(c)
    rows = [(r, cs) for r, cs in sorted(rows.items()) if any(c[3] or c[5] for c in cs)]
    box = [m[1:] for m in merges if m[0] == s]

    def label(cs):
        v = [c for c in cs if c[3] and c[4]]
        strings = sum(c[4] == "string" for c in v)
        return bool(v) and v[0][4] == "string" and strings >= 2 and strings * 2 >= len(v) and all(not c[5] and c[4] in ("string", "number") for c in v)

    out, start, low, high, last = [], top, None, None, None
    for k, (r, cs) in enumerate(rows):
        nxt = rows[k + 1][1] if k + 1 < len(rows) else None
        at = [m for m in box if m[0] == r and left <= m[1] <= m[3] <= right]
        single = sum(bool(c[3]) for c in cs) == 1
        v = [c for c in cs if c[3] and c[4]]
        head = len(v) >= 2 and all(c[4] == "string" and not c[5] for c in v)
        lower = nxt is not None and any(c[4] and c[4] != "string" for c in nxt)
        new = head and (any(m[2] > m[0] or m[3] > m[1] for m in at) or any(c[6] for c in cs) and lower)
        caption = single and any(m[3] > m[1] and m[2] == m[0] for m in at)
        section = single and nxt is not None and label(nxt) and (caption or any(c[6] for c in nxt))
        title = single and any(m[1] == left and m[3] == right and m[2] == m[0] for m in at)
        crossed = any(m[0] < r <= m[2] and m[1] <= right and m[3] >= left for m in box)
        gap = last is not None and r > last + 1
        if (gap and (new or section) or title and section and r > start + 8) and not crossed:
            out.append((a, start, low, r - 1, high))
            start, low, high = r, None, None
        columns = [c[2] for c in cs if c[3] or c[5]] + [x for m in at for x in (m[1], m[3])]
        low, high = min([*columns, low or 99]), max([*columns, high or 0])
        last = r
    return out + [(a, start, low, bottom, high)] if low is not None else [area[:1] + area[2:]]


def test_two_tables(spark):
    head = lambda r, bold: [(1, r, c, f"h{c}", "string", False, bold) for c in (1, 2, 3)]
    body = lambda r, n: [(1, r + k, c, str(k), "number", False, False) for k in range(n) for c in (1, 2)]
    cells = head(1, True) + body(2, 3) + head(6, True) + body(7, 2)
    assert run(spark, [(1, 1, 1, 1, 20, 5)], cells, []) == [(1, 1, 1, 5, 3), (1, 6, 1, 20, 3)]
    plain = [c[:6] + (False,) for c in cells]
    assert run(spark, [(1, 1, 1, 1, 20, 5)], plain, []) == [(1, 1, 1, 20, 3)]
    assert run(spark, [(1, 1, 1, 1, 20, 5)], plain, [(1, 6, 2, 6, 4)]) == [(1, 1, 1, 5, 3), (1, 6, 1, 20, 4)]
    assert run(spark, [(1, 1, 1, 1, 20, 5), (2, 9, 1, 1, 2, 2)], cells, [(1, 4, 5, 7, 5)])[0] == (1, 1, 1, 20, 5)


def test_title_without_gap(spark):
    cells = [(1, r, c, "x", "number", False, False) for r in range(1, 11) for c in (1, 2)] + [(1, 11, 1, "part two", "string", False, True)]
    cells += [(1, 12, c, "name", "string", False, False) for c in (1, 2)] + [(1, 13, c, "1", "number", False, False) for c in (1, 2)]
    assert run(spark, [(1, 1, 1, 1, 13, 2)], cells, [(1, 11, 1, 11, 2)]) == [(1, 1, 1, 10, 2), (1, 11, 1, 13, 2)]
    assert run(spark, [(1, 1, 3, 1, 13, 2)], cells, [(1, 11, 1, 11, 2)]) == [(1, 3, 1, 13, 2)]


def test_random_sheets(spark):
    rng = random.Random(21)
    areas, cells, merges = [], [], []
    for s in range(120):
        areas.append((s, s, 1, 1, 30, 4))
        for r in range(1, 31):
            if rng.random() < 0.25:
                continue
            kind, bold = rng.choice(["head", "body", "one", "mixed"]), rng.random() < 0.4
            for c in range(1, 5):
                if kind == "one" and c > 1 or rng.random() < 0.15:
                    continue
                k = {"head": "string", "body": "number", "one": "string"}.get(kind) or rng.choice(["string", "number", "date", None])
                cells.append((s, r, c, rng.choice(["t", "t", "t", "", None]), k, rng.random() < 0.05, bold))
            if rng.random() < 0.3:
                left = rng.choice([1, 1, 2])
                merges.append((s, r, left, r + rng.choice([0, 0, 0, 1]), rng.choice([4, left, 3])))
    got = run(spark, areas, cells, merges)
    want = sorted(t for a in areas for t in walk(a, cells, merges))
    assert got == want and len(got) > 200
