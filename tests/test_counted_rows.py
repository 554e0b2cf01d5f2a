"""Postings counted within rows."""

from pyspark.sql import functions as F

from siftlake.operators import keyword


def test_unique_keys_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "c"]), (2, [], []), (3, None, ["a"]), (4, ["é"], [])], "k long, x array<string>, y array<string>")
    fields = {"A": F.col("x"), "B": F.col("y")}
    once = keyword.postings(df, "k", fields, unique=True)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, keyword.postings(df, "k", fields).collect()))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
