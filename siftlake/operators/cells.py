"""Tables in spreadsheets: cells that lie together and look alike are one table.

Density clusters: a cell with LEAST neighbours of its style within EPS (itself included, the MOST_NEAR nearest counted) is a core; cores of which one counts the other are of one table, and a
cell that is no core belongs to the first table that a core counts it in. A cell's style is as far from another as makes them no neighbours.

Sheets are cut into tiles. Each tile is read with a halo of twice EPS: of all cells within EPS of it the neighbours are whole, so cores and links there are those of the sheet. A tile joins its cores to
parts of tables. Tiles share the cores near their borders: only these are linked to their parts, and the components of these links are the tables. No group is larger than a tile with its halo, whatever a sheet holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.components import components
from siftlake.sources.tables import shared_folder

EPS, LEAST, MOST_NEAR = 10, 3, 50
#: Rows and columns of a tile; more than four EPS, so that a cell is in four tiles at most. Sheets are long rather than wide.
ROWS, COLUMNS = 4096, 64
#: Steps to the places within EPS, the nearest first, then by row and column.
STEPS = sorted((r * r + c * c, r, c) for r in range(-EPS, EPS + 1) for c in range(-EPS, EPS + 1) if r * r + c * c <= EPS * EPS)


def counted(points: np.ndarray, of: np.ndarray, near: int = MOST_NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step, the places in `of` that have a neighbour there, and this neighbour: in all the `near` nearest points within EPS, itself among them. points: rows and columns, sorted; ties go to the earlier one."""
    low = points.min(axis=0) - EPS
    width = int(points[:, 1].max() - low[1]) + EPS + 1
    at = (points[:, 0] - low[0]) * width + points[:, 1] - low[1]
    place = np.arange(len(at))
    turn = place - np.maximum.accumulate(np.where(np.concatenate([[False], at[1:] == at[:-1]]), 0, place))  # among the cells at one place
    grids = []
    for k in range(min(int(turn.max()) + 1, near)):  # what comes later at its place is never among the nearest
        grid = np.full((int(points[:, 0].max() - low[0]) + EPS + 1) * width, -1, np.int32)
        grid[at[turn == k]] = place[turn == k]
        grids.append(grid)
    own, n = at[of], np.zeros(len(of), np.int64)
    for _, r, c in STEPS:
        for grid in grids:
            j = grid[own + (r * width + c)]
            hit = np.flatnonzero((j >= 0) & (n < near))
            n[hit] += 1
            yield of[hit], j[hit]


def linked(points: np.ndarray, exact: np.ndarray, own: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """core: is a place an exact core; first: the first core of its part of a table; others: (place, first core) of a tile's own other cells that a core counts, once for each part."""
    of, n = np.flatnonzero(exact), np.zeros(len(points), np.int64)
    if not len(of):
        return n > 0, n, np.zeros((0, 2), np.int64)
    for i, _ in counted(points, of):
        n[i] += 1
    core, first, others = n >= least, np.arange(len(points)), [np.zeros((2, 0), np.int64)]
    for i, j in counted(points, of):
        i, j = i[core[i]], j[core[i]]
        both = core[j]
        a, b = first[i[both]], first[j[both]]
        while len(apart := np.flatnonzero(a != b)):
            np.minimum.at(first, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (first[first] != first).any():
                first = first[first]
            a, b = first[a[apart]], first[b[apart]]
        out = ~both & own[j]
        others.append(np.stack([j[out], i[out]]))
    j, i = np.concatenate(others, axis=1)
    return core, first, np.unique(np.stack([j, first[i]], axis=1), axis=0)


def tables(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """cells (sheet, row, col, style, and others) with table_row and table_col: the first core of its table, or null. A sheet has one cell at a place; null places and styles are of no table."""
    spark = cells.sparkSession
    at = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    rows = kept(cells.withColumn("_n", F.monotonically_increasing_id()), "cells")
    placed = rows.where("row IS NOT NULL AND col IS NOT NULL AND style IS NOT NULL").select("_n", F.col(sheet).alias("sheet"), "style", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    # Tiles begin at -2 EPS, so that the first rows and columns lie in one.
    tiles = lambda c, size: F.array_distinct(F.array(F.floor(F.col(c) / size), F.floor((F.col(c) + 4 * EPS) / size)))
    dealt = placed.withColumn("tr", F.explode(tiles("row", ROWS))).withColumn("tc", F.explode(tiles("col", COLUMNS)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["row", "col", "_n"])
        points, n = p[["row", "col"]].to_numpy(np.int64), p["_n"].to_numpy(np.int64)
        begin = p[["tr", "tc"]].to_numpy(np.int64) * (ROWS, COLUMNS) - 2 * EPS
        end = begin + (ROWS - 1, COLUMNS - 1)
        away = np.maximum(np.maximum(begin - points, points - end), 0).max(axis=1)
        inner = np.minimum(points - begin, end - points).min(axis=1)
        core, first, others = linked(points, away <= EPS, away == 0)
        own, shared, parts = np.flatnonzero(core & (away == 0)), np.flatnonzero(core & (inner < EPS)), np.unique(first[core])
        a = np.concatenate([own, others[:, 0], shared, parts])
        b = np.concatenate([first[own], others[:, 1], first[shared], parts])
        kind = np.repeat(np.arange(4), [len(own), len(others), len(shared), len(parts)])
        return pd.DataFrame({"a": n[a], "b": n[b], "kind": kind.astype(np.int32), "row": points[b, 0], "col": points[b, 1]})

    # Kinds: a tile's own cores and its other cells, each with the first core of their part; shared cores likewise; the parts' first cores.
    links = kept(dealt.groupBy("sheet", "style", "tr", "tc").applyInPandas(run, "a long, b long, kind int, row long, col long"), "links")
    groups = components(links.where("kind = 2").select("a", "b"))
    parts = links.where("kind = 3").select(F.col("b").alias("node"), F.struct("row", "col").alias("first")).distinct()
    parts = kept(parts.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "parts")
    first = kept(parts.select("node", "component").join(parts.groupBy("component").agg(F.min("first").alias("first")), "component").select(F.col("node").alias("b"), "first"), "first")
    cores = links.where("kind = 0").join(first, "b").select(F.col("a").alias("_n"), "first")
    others = links.where("kind = 1").join(first, "b").groupBy(F.col("a").alias("_n")).agg(F.min("first").alias("first"))
    return rows.join(cores.unionAll(others), "_n", "left").select(*cells.columns, F.col("first.row").alias("table_row"), F.col("first.col").alias("table_col"))
