"""Clusters of cells against a plain version over whole sheets, and components of graphs."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import cells
from siftlake.operators.components import components


def plain_components(edges):
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(7, 7), (5, 9), (9, 5)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == plain_components(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1)


def plain_tables(points):
    """{place: first core of its table or None} of the cells of one style on one sheet."""
    points = sorted(points)
    near = {}
    for p in points:
        by = sorted((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), q) for q in points if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 100)
        near[p] = [q for _, q in by[:50]]
    core = {p for p in points if len(near[p]) >= 3}
    low = plain_components([(p, q) for p in core for q in near[p] if q in core])
    out = {p: low[p] for p in core}
    for p in core:
        for q in near[p]:
            if q not in core:
                out[q] = min(out.get(q, low[p]), low[p])
    return {p: out.get(p) for p in points}


def test_tables_equal_whole_sheets(spark):
    """Blocks of cells, some across tiles, some nearly touching, sparse rows, alone cells, a long dense strip; two styles."""
    rng = random.Random(8)
    sheets = {}
    for sheet in (1, 2):
        taken = {}
        for _ in range(14):
            r, c, h, w, style = rng.randint(-30, 230), rng.randint(0, 200), rng.randint(1, 30), rng.randint(1, 12), rng.choice("xy")
            for i in range(h):
                for j in range(w):
                    if rng.random() < 0.8:
                        taken.setdefault((r + i, c + j), style)
        for i in range(0, 500, 7):
            taken.setdefault((i, 250), "x")
        for _ in range(25):
            taken.setdefault((rng.randint(0, 400), rng.randint(260, 400)), "y")
        sheets[sheet] = taken
    rows = [(s, r, c, style, f"{r}/{c}") for s, taken in sheets.items() for (r, c), style in taken.items()] + [(3, 5, 5, "x", "alone"), (3, None, 5, "x", "nowhere"), (None, 1, 1, "x", "a"), (None, 1, 2, "x", "b"), (None, 2, 1, "x", "c")]
    got = cells.tables(spark.createDataFrame(rows, "sheet int, row int, col int, style string, value string").repartition(3)).collect()
    assert len(got) == len(rows)
    for s, taken in sheets.items():
        for style in "xy":
            want = plain_tables([p for p, x in taken.items() if x == style])
            assert {(r.row, r.col): None if r.table_row is None else (r.table_row, r.table_col) for r in got if r.sheet == s and r.style == style} == want
            assert len(set(want.values())) > 2
    assert {r.value: r.table_row for r in got if r.sheet not in (1, 2)} == {"alone": None, "nowhere": None, "a": 1, "b": 1, "c": 1}


def test_no_cells(spark):
    assert cells.tables(spark.createDataFrame([], "sheet int, row int, col int, style string")).count() == 0


def test_only_cores_near_borders_are_linked_across_tiles(spark, monkeypatch):
    """A strip of 700 rows over a tile's border: a table of its own rows is not linked cell by cell."""
    points = [(r, c) for r in range(3700, 4400) for c in range(2)] + [(4500 + i, 5) for i in range(3)]
    links = []
    monkeypatch.setattr(cells, "components", lambda edges: (links.append(edges.count()), components(edges))[1])
    got = cells.tables(spark.createDataFrame([(1, r, c, "x") for r, c in points], "sheet int, row int, col int, style string")).collect()
    assert {(r.row, r.col): (r.table_row, r.table_col) for r in got} == {p: (3700, 0) if p[0] < 4500 else (4500, 5) for p in points}
    assert 0 < links[0] <= 4 * 2 * 2 * cells.EPS
