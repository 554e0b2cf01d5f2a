"""The vector index against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import vector, vector_index

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n, groups, seed=3, dims=24):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, dims))
    x = mid[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA)


def asked(df, every):
    return df.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def hits(a, b):
    both = {(r.query_id, r.vec_id) for r in a.collect()}, {(r.query_id, r.vec_id) for r in b.collect()}
    return len(both[0] & both[1]) / len(both[1])


def test_few_cells_are_opened_where_vectors_form_groups(spark, tmp_path):
    df = table(spark, 4000, 40)
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix", parts=8, near=10)
    q = asked(df, 50)
    assert ix.model.probe <= len(ix.model.centres) / 4 and ix.n == 4000
    assert hits(ix.search(q, 10, depth=100), vector.nearest_many(df, q, 10, "vec_id")) >= 0.95
    # Opened cells are partitions of the table; the first pass reads no vectors.
    plan = ix.rows.where(F.col("cell").isin([1, 2])).select("cell", "vec_id", "code")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "vector" not in plan.split("ReadSchema")[1]


def test_all_cells_and_depth_give_the_exact_result(spark, tmp_path):
    df = table(spark, 300, 3).unionAll(spark.createDataFrame([(1000 + i, [1.0] * 24) for i in range(30)], SCHEMA))
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix", cells=6)
    q = asked(df, 25)
    got = ix.search(q, 7, depth=330, probe=6).orderBy("query_id", "rank").collect()
    want = vector.nearest_many(df, q, 7, "vec_id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.distance) for r in got] == [(r.query_id, r.rank, r.vec_id, r.distance) for r in want]
    one = vector.nearest(df, vector.query_vector(df, "vec_id", 50), 7, "vec_id").orderBy("rank").collect()
    assert [r.vec_id for r in one] == [r.vec_id for r in want if r.query_id == 50]
    again = vector_index.open_index(spark, ix.root)
    assert again.n == ix.n and again.model.probe == ix.model.probe and again.search(q, 7).count() == 7 * q.count()


def test_odd_vectors(spark, tmp_path):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [3.0, 4.0]), (6, [3.0, 4.0]), (7, [-3.0, 4.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix")
    assert ix.n == 3
    got = ix.search(asked(df, 1), 2, probe=3).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(5, 1, 5), (5, 2, 6), (6, 1, 5), (6, 2, 6), (7, 1, 7), (7, 2, 5)}
    assert ix.search(asked(df, 1).where("query_id = 1"), 2).count() == 0
    empty = vector_index.build(df.where("false"), "vec_id", f"file://{tmp_path}/none")
    assert empty.n == 0 and empty.search(asked(df, 1), 2).count() == 0


def test_one_vector_holds_a_third(spark, tmp_path):
    df = table(spark, 600, 5).unionAll(spark.createDataFrame([(10_000 + i, [1.0] + [0.0] * 23) for i in range(300)], SCHEMA))
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix")
    big = ix.rows.withColumn("file", F.input_file_name()).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).orderBy(F.desc("n")).first()
    assert big.n >= 300 and big.files > 1


def test_search_is_exact_below_the_limit_and_by_the_index_above(spark, tmp_path):
    df = table(spark, 500, 8)
    q = vector.query_vector(df, "vec_id", 3)
    exact = [r.vec_id for r in vector.nearest(df, q, 5, "vec_id").orderBy("rank").collect()]
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix")
    assert [r.vec_id for r in vector.adaptive(df, q, 5, "vec_id", lambda: pytest.fail("not needed")).orderBy("rank").collect()] == exact
    assert len({r.vec_id for r in vector.adaptive(df, q, 5, "vec_id", lambda: ix, limit=100).collect()} & set(exact)) >= 4
    odd = vector.adaptive(df.where("vec_id % 2 = 1"), q, 5, "vec_id", lambda: ix, limit=100).collect()
    assert len(odd) == 5 and all(r.vec_id % 2 for r in odd)


def test_queries_come_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "MOST_QUERIES", 16)
    df = table(spark, 200, 4)
    with pytest.raises(ValueError):
        vector.nearest_many(df, asked(df, 1), 3, "vec_id")
    assert vector_index.in_blocks(asked(df, 10), lambda x: vector.nearest_many(df, x, 3, "vec_id")).count() == 60


def test_search_by_bounds_is_exact(spark, tmp_path):
    """Vectors without groups, some twice: the same rows as reading all vectors, in all and among some."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate([x, x[:500]]).tolist())], SCHEMA)
    ix = vector_index.build(df, "vec_id", f"file://{tmp_path}/ix")
    q = vector.query_vector(df, "vec_id", 3)
    shown = lambda out: [(r.vec_id, r.distance, r["rank"]) for r in out.orderBy("rank").collect()]
    for some in (df, df.where("vec_id % 3 = 1")):
        assert shown(vector.adaptive(some, q, 20, "vec_id", lambda: ix, limit=100).select("vec_id", "distance", "rank")) == shown(vector.nearest(some, q, 20, "vec_id"))
    found = ix.search(asked(df, 50), 20, depth=50)
    assert hits(found, vector.nearest_many(df, asked(df, 50), 20, "vec_id")) >= 0.95
