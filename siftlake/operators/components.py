"""Connected components of a graph in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.sources.tables import shared_folder


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that it is linked with) of all nodes of edges (a, b).

    Every round hangs each node's larger neighbours on its smallest neighbour, then each node's smaller ones; the links left form stars. Rounds are written; they grow with the logarithm of the nodes.
    A graph that has not settled after most_rounds is an error.
    """
    spark = edges.sparkSession
    at = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, nth: int) -> DataFrame:
        df.write.parquet(f"{at}/{nth}")
        return spark.read.schema(df.schema).parquet(f"{at}/{nth}")

    def hung(links: DataFrame) -> DataFrame:
        """Links (u, v) with u > v to links to the smallest: first of the larger neighbours, then of the smaller ones."""
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        return large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()

    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    links = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), 0)
    was = mark(links)
    for nth in range(1, most_rounds + 1):
        links = kept(hung(links), nth)
        before, was = was, mark(links)
        if was == before:
            return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
