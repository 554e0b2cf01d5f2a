"""Joining two ranked lists. Lists are pages of results; both carry an explicit rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(semantic: DataFrame, keyword: DataFrame, key: str, weight: float = 0.5, rank: str = "rank") -> DataFrame:
    """key, score, rank: weight / (60 + rank) of the first list plus (1 - weight) / (60 + rank) of the second; ties in order of arrival."""
    part = lambda df, w, side: df.select(key, (w / (60 + F.col(rank))).alias("score"), F.struct(F.lit(side).alias("side"), F.col(rank).alias("at")).alias("seen"))
    both = part(semantic, weight, 0).unionByName(part(keyword, 1 - weight, 1)).groupBy(key).agg(F.sum("score").alias("score"), F.min("seen").alias("seen"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "seen"))).drop("seen")


def share(score: Column) -> Column:
    """A score over its list's sum; null where the sum is 0."""
    return F.try_divide(score, F.sum(score).over(Window.partitionBy()))


def rescaled(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """key, score, rank: sums of the lists' score shares."""
    part = lambda df: df.select(key, F.coalesce(share(F.col("score")), F.lit(0.0)).alias("score"))
    both = part(semantic).unionByName(part(keyword)).groupBy(key).agg(F.sum("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), key)))


def simple(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """The first list and what only the second has, by plain score."""
    rest = keyword.select(key, "score").join(semantic.select(key), key, "left_anti")
    both = semantic.select(key, "score").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), key)))


def softmax(score: Column) -> Column:
    return F.exp(score) / F.sum(F.exp(score)).over(Window.partitionBy())


def first_of_score(ranked: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    """The first row of every distinct score."""
    return ranked.groupBy(score).agg(F.min_by(F.struct(*ranked.columns), rank).alias("x")).select("x.*")


def coverage_cut(ranked: DataFrame, limit: float = 1.0, most: int = 20, score: str = "score", rank: str = "rank") -> DataFrame:
    """Rows while the scores before them sum to less than the limit, at most `most`."""
    before = F.coalesce(F.sum(score).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ranked.withColumn("before", before).where((F.col("before") < limit) & (F.col(rank) <= most)).drop("before")
