"""What the operators share: scratch tables in the cluster's shared folder and sizing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own on a local master; on a cluster that is an error, as its machines share no such folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_open: list[list[Scratch]] = []


class Scratch:
    """Written tables that cut lineage. Every executor can read them, so a lost executor loses nothing.

    The tables stay until drop() is called or the `dropping` around ends: results read them lazily.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/siftlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self)

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", compression).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping() -> Iterator[None]:
    """Scratch tables made inside are dropped at the end; write or collect what reads them before."""
    _open.append([])
    try:
        yield
    finally:
        for s in _open.pop():
            s.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, group: str, order: list[str | Column], scratch: Scratch, name: str = "placed") -> tuple[DataFrame, DataFrame]:
    """The rows with `place`, their number from 0 within their group in the given order, and `total`, the group's rows; and the sizes of the groups by task.

    Rows are range-sorted by group and order and written with a running number, so that a group may span any number of tasks; a row's place is its
    number less that of its group's first row in the task, plus the group's rows in the tasks before. df is read twice (Spark samples its ranges): hand
    in a written table. group holds no null; rows that tie in the whole order are in any order.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order)
    rows = scratch.keep(ordered.withColumn("_nth", F.monotonically_increasing_id()), name).withColumn("_task", F.shiftright("_nth", 33))
    own, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_task").agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))
    # A row for each group of each task: a table of its own, so that Spark knows its size before it chooses the join.
    spans = scratch.keep(counts.select(group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total")), f"{name}_spans")
    return rows.join(spans, [group, "_task"]).withColumn("place", F.col("_nth") + F.col("_shift")).drop("_nth", "_task", "_shift"), spans
