"""Vector search: exact top-k under filters, one best per group, cross-lingual, and the choice between these and an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import vectors as V
from siftlake.operators.vector_index import Index, collected, has_direction

#: Candidates from which a search turns to the approximate index.
EXACT_LIMIT = 70_000


def query_vector(df: DataFrame, key: str, value: int, vector: str = "embedding") -> list[float]:
    """One row's vector, as a literal for the plan."""
    row = df.where(F.col(key) == value).select(vector).first()
    if row is None:
        raise ValueError("no such query vector")
    return [float(x) for x in row[0]]


def distance(v: Column, q: list[float], metric: str = "cosine") -> Column:
    if metric == "cosine":
        return V.cosine_distance(v, q)
    return V.l2_distance(v, q) if metric == "l2" else -V.dot(v, q)


def nearest(df: DataFrame, q: list[float], k: int, key: str, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k nearest rows with distance and rank, ties to the smaller key: a top-k in each task, then one merge."""
    few = df.withColumn("distance", F.round(distance(F.col(vector), q, metric), 9)).drop(vector).orderBy("distance", key).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def crosslingual(df: DataFrame, lang: str, q_own: list[float], q_english: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """Rows of the query's language meet its own vector, all others the English one; one scan."""
    d = F.when(F.col("lang") == lang, distance(F.col(vector), q_own)).otherwise(distance(F.col(vector), q_english))
    few = df.withColumn("distance", F.round(d, 9)).drop(vector).orderBy("distance", key).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def best_per_group(df: DataFrame, q: list[float], group: str, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """Each group's nearest row, then the k nearest of these."""
    scored = df.select(group, key, F.round(distance(F.col(vector), q), 9).alias("distance"))
    best = scored.groupBy(group).agg(F.min(F.struct("distance", key)).alias("b")).select(group, F.col(f"b.{key}").alias(key), "b.distance")
    return best.orderBy("distance", group).limit(k).withColumn("rank", F.row_number().over(Window.orderBy("distance", group)))


def nearest_many(df: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """query_id, key, distance (cosine) and rank of the k nearest rows of each query (query_id, vector) of a block: all rows are read, each task keeps its best k of each query."""
    asked = collected(queries)
    kind, own = df.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    q = np.array([r.vector for r in asked]).reshape(len(asked), -1)
    q /= np.sqrt((q * q).sum(1))[:, None]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if len(q) else ():
            x = np.array(b.column("vector").to_pylist(), np.float64).reshape(b.num_rows, -1)
            away = np.round(1 - q @ (x / np.sqrt((x * x).sum(1))[:, None]).T, 9)
            # All that is as near as the k-th, so that ties are left to their keys.
            upto = np.partition(away, min(k, b.num_rows) - 1, axis=1)[:, min(k, b.num_rows) - 1]
            nth, row = np.nonzero(away <= upto[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(nth.astype(np.int32)), b.column(key).take(pa.array(row)), pa.array(away[nth, row])], names=["nth", key, "distance"])

    rows = df.select(key, F.col(vector).cast("array<double>").alias("vector")).where(has_direction(F.col("vector")))
    best = rows.mapInArrow(scored, f"nth int, {key} {kind}, distance double")
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy("distance", key))).where(F.col("rank") <= k)
    names = df.sparkSession.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"nth int, query_id {own}")
    return top.join(F.broadcast(names), "nth").select("query_id", key, "distance", "rank")


def adaptive(df: DataFrame, q: list[float], k: int, key: str, index: Callable[[], Index], vector: str = "embedding", limit: int = EXACT_LIMIT) -> DataFrame:
    """By all vectors below `limit` candidates, else by the bounds of the index of the whole table, among the candidates: the same rows; counting stops at the limit. index: opens it, or builds it where there is none."""
    if df.limit(limit).count() < limit:
        return nearest(df.select(key, vector), q, k, key, vector)
    return index().exact(q, k, among=df.select(key))


def maximal_marginal_relevance(df: DataFrame, q: list[float], k: int, fetch: int, key: str, vector: str = "embedding", weight: float = 0.5) -> DataFrame:
    """k of the `fetch` nearest rows: each pick is close to the query and unlike the ones before. At most `fetch` rows, folded in one expression.

    Output keeps the candidates' order (rank) and tells the order of the picks (pick).
    """
    near = nearest(df.withColumn("v", F.col(vector).cast("array<double>")), q, fetch, key, vector)
    rows = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", key, "distance", "v"))).alias("c"))

    def pick(picked: Column, _: Column) -> Column:
        left = F.filter(F.col("c"), lambda x: ~F.exists(picked, lambda p: p["rank"] == x["rank"]))
        worth = F.transform(left, lambda x: F.struct((-(weight * (1 - x["distance"]) - (1 - weight) * F.coalesce(F.array_max(F.transform(picked, lambda p: V.pair_cosine(p["v"], x["v"]))), F.lit(0.0)))).alias("cost"), x["rank"].alias("rank"), x.alias("x")))
        return F.when(F.size(left) == 0, picked).otherwise(F.concat(picked, F.array(F.array_min(worth)["x"])))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.slice(F.col("c"), 1, 0), pick)
    return rows.select(F.posexplode(chosen).alias("pick", "x")).select(F.col(f"x.{key}").alias(key), "x.rank", "x.distance", (F.col("pick") + 1).alias("pick"))


def diverse(ranked: DataFrame, threshold: float, rank: str = "rank", vector: str = "v") -> DataFrame:
    """Walks at most a page of results in rank order and drops a row whose cosine with a kept one is over the threshold."""
    rows = ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct(rank, *[c for c in ranked.columns if c != rank]))).alias("c"))
    keep = lambda kept, x: F.when(F.exists(kept, lambda p: V.pair_cosine(p[vector], x[vector]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    return rows.select(F.explode(F.aggregate("c", F.slice(F.col("c"), 1, 0), keep)).alias("x")).select("x.*")
