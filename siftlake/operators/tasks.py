"""Tasks that depend on each other: levels, readiness, dangling references. A graph is a table of any size: tasks with their ids and what they need."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.sources.tables import shared_folder


def edges(tasks: DataFrame, key: list[str] = []) -> DataFrame:
    return tasks.select(*key, "task_id", F.explode("depends_on").alias("needs"))


def dangling(tasks: DataFrame) -> DataFrame:
    return edges(tasks).join(tasks.select(F.col("task_id").alias("needs")), "needs", "left_anti").select("task_id", "needs")


def ready(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that are not done and whose needs all are."""
    open_ = edges(tasks).join(done.select(F.col("task_id").alias("needs")), "needs", "left_anti").select("task_id")
    return tasks.join(done.select("task_id"), "task_id", "left_anti").join(open_, "task_id", "left_anti").select("task_id")


def levels(tasks: DataFrame, plan: str | None = None) -> DataFrame:
    """(plan,) task_id, level (0: needs nothing that is there; null: on a cycle or behind one), terminal (nothing needs it).

    In rounds: a round counts the needs that the tasks freed by the one before meet, adds the counts of tasks that wait for more, and frees those whose needs are all met. It reads the edges, but
    shuffles and writes only the tasks it touched and those that wait with a part of their needs met; tasks that nothing reached yet are in no state. Few free tasks are broadcast by Spark, so
    that edges are shuffled in the rounds of large levels only. The state is written, so that nothing is held in one place and a lost executor costs a task, not the rounds. A task is free in
    the round of its longest way, so there are as many rounds as levels; what never gets free is on a cycle or behind one. Rows of one id are one task; needs that no task has do not count.
    """
    spark = tasks.sparkSession
    ids = [*([plan] if plan else []), "task_id"]
    at = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    known = tasks.select(*ids)
    needs = known.withColumnRenamed("task_id", "needs")
    found = kept(edges(tasks, ids[:-1]).distinct().join(needs, needs.columns, "left_semi").select(*ids, "needs"), "found")
    # A task's number of needs stands at each of its edges: no round has to look it up.
    all_edges = kept(found.join(found.groupBy(*ids).agg(F.count("*").alias("degree")), ids), "edges")
    none = F.lit(0).cast("long")
    state = kept(known.join(found.select(*ids), ids, "left_anti").distinct().select(*ids, none.alias("met"), none.alias("degree")), "state/round=0")
    nth = 0
    while not (free := state.where("met = degree").select(*ids)).isEmpty():
        touched = all_edges.join(free.withColumnRenamed("task_id", "needs"), needs.columns).groupBy(*ids).agg(F.count("*").alias("met"), F.max("degree").alias("degree"))
        both = state.where("met < degree").unionByName(touched)
        nth += 1
        state = kept(both.groupBy(*ids).agg(F.sum("met").alias("met"), F.max("degree").alias("degree")), f"state/round={nth}")
    every = spark.read.schema(f"{', '.join(f'{c} {known.schema[c].dataType.simpleString()}' for c in ids)}, met long, degree long, round int").parquet(f"{at}/state")
    level, asked = F.lit(None).cast("int").alias("level"), F.lit(False).alias("asked")
    seen = [known.select(*ids, level, asked), every.where("met = degree").select(*ids, F.col("round").alias("level"), asked), found.select(*ids[:-1], F.col("needs").alias("task_id"), level, F.lit(True).alias("asked"))]
    return reduce(DataFrame.unionAll, seen).groupBy(*ids).agg(F.max("level").alias("level"), (~F.max("asked")).alias("terminal"))


def cycles(tasks: DataFrame) -> DataFrame:
    """Tasks that can never be ready: on a cycle or behind one."""
    return levels(tasks).where("level IS NULL").select("task_id")
