"""Named queries, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a split, where input is dealt out.
SPLIT_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer splits than half the cores, or with most rows in few of them, dealt out before costly expressions; other input is left as it is.

    A file is read by row groups: one of a single large group has many splits, and all of its rows in one. Rows by split are read from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores // 2:
        return df.repartition(cores)
    rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return df.repartition(max(cores, -(-rows.n // SPLIT_ROWS))) if rows.n and rows.most > SPLIT_ROWS and rows.most * cores > 2 * rows.n else df


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are costly to work on."""
    return spread(load(spark, sf_dir, name))
