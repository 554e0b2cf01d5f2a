"""The stored postings against plain counting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import keyword, keyword_index

SCHEMA = "k long, a array<string>, b array<string>"


def units(n, seed=1):
    """Rare words gather in few units; one word is in all."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        a = ["all"] + [rng.choice(words) for _ in range(rng.randint(0, 12))] + (["rare"] * rng.randint(1, 5) if 300 <= i < 330 else [])
        rows.append((i * 3, a, [rng.choice(words) for _ in range(rng.randint(0, 3))]))
    return rows


def plain(rows, lexemes):
    """Scores by the formulas, occurrence by occurrence."""
    tf = {}
    for k, a, b in rows:
        for x in lexemes:
            w = [1.0] * a.count(x) + [0.4] * b.count(x)
            if w:
                tf[k, x] = sum(v / ((j + 1) * (j + 1)) for j, v in enumerate(w)) / 1.64493406685
    df = {x: sum(1 for _, y in tf if y == x) for x in lexemes}
    out = {}
    for (k, x), v in tf.items():
        out[k] = out.get(k, 0.0) + v / (v + 1) * math.log(1 + (len(rows) - df[x] + 0.5) / (df[x] + 0.5))
    return sorted(out.items(), key=lambda r: (-round(r[1], 9), r[0]))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = units(900)
    at = f"file://{tmp_path_factory.mktemp('ix')}/ix"
    keyword_index.RANGE, before = 50, keyword_index.RANGE
    ix = keyword_index.build(spark.createDataFrame(rows, SCHEMA), "k", {"A": F.col("a"), "B": F.col("b")}, at)
    keyword_index.RANGE = before
    return rows, ix


@pytest.mark.parametrize("lexemes", [["rare"], ["all"], ["rare", "all", "w1"], ["w1", "w2", "w3", "none"], ["none"], []])
def test_top_equals_plain_scores(spark, built, lexemes):
    rows, ix = built
    want = plain(rows, lexemes)
    got = ix.top(lexemes, 10).orderBy("rank").collect()
    assert [(r.k, round(r.s, 9)) for r in got] == [(k, round(s, 9)) for k, s in want[:10]]
    every = {r.k: round(r.s, 9) for r in ix.all_scores(lexemes).collect()}
    assert every == {k: round(s, 9) for k, s in want}


def test_ranges_below_the_floor_are_left_out(built):
    rows, ix = built
    weights = ix.weights(["rare", "all"])
    floor, more = ix.floor(weights, 5)
    bounds = {r["range"]: r.bound for r in ix.bounds(weights).collect()}
    assert more and len(bounds) == 18 and sum(b >= floor for b in bounds.values()) <= 3
    best = dict(plain(rows, ["rare", "all"]))
    for (k, s) in best.items():
        assert s <= bounds[k // (ix_width(rows))]


def ix_width(rows):
    low, high = rows[0][0], rows[-1][0]
    return -(-(high - low + 1) * 50 // len(rows))


def test_only_the_lexemes_partitions_are_read(built):
    _, ix = built
    plan = ix.rows(["rare"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "lexeme" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    heads = ix.bounds({"rare": 1.0})._jdf.queryExecution().toString()
    assert "units" not in heads.split("ReadSchema")[1]


def test_odd_units(spark, tmp_path):
    rows = [(5, [], []), (-7, ["x"], ["x"]), (9, ["x"] * 3000, []), (10, ["ü", "ü"], ["日本"])]
    ix = keyword_index.build(spark.createDataFrame(rows, SCHEMA), "k", {"A": F.col("a"), "B": F.col("b")}, f"file://{tmp_path}/ix")
    assert ix.n_all == 4
    assert [(r.k, round(r.s, 9)) for r in ix.top(["x", "日本"], 9).orderBy("rank").collect()] == [(k, round(s, 9)) for k, s in plain(rows, ["x", "日本"])]
    none = keyword_index.build(spark.createDataFrame([], SCHEMA), "k", {"A": F.col("a"), "B": F.col("b")}, f"file://{tmp_path}/none")
    assert none.top(["x"], 3).count() == 0 and keyword_index.open_index(spark, none.root).n_all == 0


def test_rank_of_classes(spark):
    got = spark.range(1).select(keyword_index.class_rank(F.lit(2), F.lit(1)).alias("x"), keyword.ts_rank_weighted(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.4))).alias("y"), keyword_index.class_rank(F.lit(0), F.lit(2)).alias("b")).first()
    assert abs(got.x - got.y) < 1e-12 and abs(got.b - 0.4 * 1.25 / 1.64493406685) < 1e-12
