"""Running sums within groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.sources.tables import shared_folder


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, str] | None = None) -> DataFrame:
    """The rows with `place`, their number from 0 within their group, and the sums of columns up to and with their row (values: new name to column).

    In two levels, so that a group is not one task: rows are range-sorted by group and order and written with their task; sums are taken within each task's part of
    a group and moved on by the parts' totals, of which there is one for each task and group. Groups may be null; rows that tie in the order are in any order.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {"place": None, **(values or {})}
    at = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange(tasks, *group, *order).sortWithinPartitions(*group, *order).withColumn("_nth", F.monotonically_increasing_id())
    ordered.write.parquet(f"{at}/rows")
    rows = spark.read.schema(ordered.schema).parquet(f"{at}/rows").withColumn("_task", F.shiftright("_nth", 33))
    one = {n: F.lit(1).cast("long") if c is None else F.col(c) for n, c in values.items()}
    within = Window.partitionBy(*group, "_task").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_task").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in one.items()])
    parts = totals.select(*group, "_task", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values])
    parts.write.parquet(f"{at}/parts")
    parts = spark.read.schema(parts.schema).parquet(f"{at}/parts")
    summed = rows.withColumns({n: F.sum(v).over(within) for n, v in one.items()})
    same = [summed[c].eqNullSafe(parts[c]) for c in (*group, "_task")]
    met = summed.join(parts, same).drop(*[parts[c] for c in (*group, "_task")])
    moved = met.withColumns({n: F.col(n) + F.col(f"_before_{n}") - (1 if n == "place" else 0) for n in values})
    return moved.drop("_nth", "_task", *[f"_before_{n}" for n in values])
