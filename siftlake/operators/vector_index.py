"""An index of vectors that is read in part: cells of like vectors, short codes, and exact distances for few.

Build: k-means on a bounded sample of unit vectors gives the cells' centres; what is left of a vector in its cell is cut into parts, and each part is
coded by the nearest of 256 values learnt from the sample (a product code of one byte a part; a part is one dimension, if these are 128 at most). All rows are written with cell, code, vector and
err, how far the vector is from what its code says, partitioned by cell and sorted
by key, a cell of any size over many files. Search: the cells nearest to a query are read, keys and codes only; each task keeps its best `depth` rows by their decoded vectors;
the best `depth` of all are read again with their vectors and ranked by exact distance.

How many cells a search opens is measured when the index is built: so many that `coverage` of the sampled rows' nearest ones lie in them. Where vectors form
groups these are few; vectors without any structure need most cells, and then only the codes save reading.

An exact search reads the codes of all cells: err bounds a row's product from both sides, the k-th best lower bound is a floor, and the vectors of all rows whose upper bound reaches it are read.

Vectors that are null, hold nulls or have no length are not indexed. Rows with equal distance are ordered by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import vectors as V

#: Rows that the index is fitted on, at most twice so many; queries of one search; keys that become part of the plan.
SAMPLE, MOST_QUERIES, FEW_KEYS = 20_000, 1024, 1024


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres; an empty one moves to a random row."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if centres.shape[1] == 1:  # along a line: between the middles
        order = np.argsort(centres[:, 0], kind="stable")
        c = centres[order, 0]
        return order[np.searchsorted((c[1:] + c[:-1]) / 2, x[:, 0])]
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


@dataclass
class Model:
    centres: np.ndarray  #: cells x dimensions
    books: np.ndarray  #: parts x values x dimensions of a part
    probe: int

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of unit vectors."""
        cell = nearest_centre(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return cell, np.stack([nearest_centre(rest[:, j], self.books[j]) for j in range(len(self.books))], axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([self.books[j][code[:, j]] for j in range(len(self.books))], axis=1)

    def nearest_cells(self, q: np.ndarray) -> np.ndarray:
        """Of each unit vector, the nearest first."""
        return np.argsort(-(q @ self.centres.T - (self.centres * self.centres).sum(1) / 2), axis=1, kind="stable")


def fitted(x: np.ndarray, cells: int, parts: int, coverage: float, near: int, seed: int) -> Model:
    """A model of a sample of unit vectors. parts divides the dimensions."""
    rng = np.random.default_rng(seed)
    centres = k_means(x, min(cells, len(x)), rng)
    rest = (x - centres[nearest_centre(x, centres)]).reshape(len(x), parts, -1)
    model = Model(centres, np.stack([k_means(rest[:, j], min(256, len(x)), rng) for j in range(parts)]), len(centres))
    # Cells that hold the nearest rows of sampled rows, themselves left out.
    at = rng.choice(len(x), min(256, len(x)), replace=False)
    like = x[at] @ x.T
    like[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-like, axis=1)[:, : min(near, max(1, len(x) - 1))]
    turn = np.argsort(model.nearest_cells(x[at]), axis=1)
    needed = np.take_along_axis(turn, nearest_centre(x, centres)[best], axis=1)
    model.probe = int(np.quantile(needed, coverage, method="higher")) + 1
    return model


def _units(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def has_direction(vector: Column) -> Column:
    """Not null, without nulls, and of a finite length over 0."""
    d = vector.cast("array<double>")
    total = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce((total > 0) & (total < float("inf")), F.lit(False))


def collected(queries: DataFrame) -> list:
    """Rows (query_id, vector) of a block of queries."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(has_direction(F.col("vector"))).limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search in blocks")
    return asked


def in_blocks(queries: DataFrame, search) -> DataFrame:
    """search(block) of any number of queries (query_id, vector), by blocks of about half of what goes to the tasks at once."""
    n = -(-queries.count() // (MOST_QUERIES // 2))
    found = [search(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)] or [search(queries)]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


@dataclass
class Index:
    spark: SparkSession
    root: str
    key: str
    kind: str  #: type of the key
    element: str  #: type of a vector's elements
    model: Model
    n: int

    @cached_property
    def rows(self) -> DataFrame:
        """cell, key, code and vector. The table's files are listed once."""
        return self.spark.read.schema(f"{self.key} {self.kind}, vector array<{self.element}>, code binary, err double, cell int").parquet(f"{self.root}/rows")

    def search(self, queries: DataFrame, k: int, depth: int | None = None, probe: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """query_id, key, distance and rank of about the k nearest rows of each query (query_id, vector). At most MOST_QUERIES at once: they go to every task.

        depth: rows of each query that are ranked by exact distance (5 k if not given); probe: cells that are opened; among: keys that may be found.
        """
        asked = collected(queries)
        depth, model, key = depth or 5 * k, self.model, self.key
        out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {self.kind}, distance double, rank int"
        if not asked or not self.n:
            return self.spark.createDataFrame([], out)
        q = np.array([r.vector for r in asked])
        q /= np.sqrt((q * q).sum(1))[:, None]
        open_cells = model.nearest_cells(q)[:, : probe or model.probe]
        asks = np.zeros((len(model.centres), len(q)), bool)
        asks[open_cells.ravel(), np.repeat(np.arange(len(q)), open_cells.shape[1])] = True

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
                like = np.where(asks[cell].T, q @ model.decoded(cell, code).T, -np.inf)
                few = min(depth, len(cell))
                best = np.argpartition(-like, few - 1, axis=1)[:, :few]
                nth, row = np.repeat(np.arange(len(q)), few), best.ravel()
                good = np.isfinite(like[nth, row])
                nth, row = nth[good], row[good]
                yield pa.RecordBatch.from_arrays([pa.array(nth.astype(np.int32)), pa.array(cell[row].astype(np.int32)), b.column(key).take(pa.array(row)), pa.array(like[nth, row])], names=["nth", "cell", key, "like"])

        codes = self.rows.where(F.col("cell").isin(np.unique(open_cells).tolist())).select("cell", key, "code")
        codes = codes if among is None else codes.join(among.select(key), key, "left_semi").select("cell", key, "code")
        best = codes.mapInArrow(scored, f"nth int, cell int, {key} {self.kind}, like double")
        few = best.withColumn("r", F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("like"), key))).where(F.col("r") <= depth).select("nth", "cell", key).collect()
        near = self.rows.where(F.col("cell").isin(sorted({r.cell for r in few})))
        if len(keys := {r[key] for r in few}) <= FEW_KEYS:
            near = near.where(F.col(key).isin(list(keys)))
        # At most depth rows a query.
        pairs = self.spark.createDataFrame([(r.nth, r.cell, r[key]) for r in few], f"nth int, cell int, {key} {self.kind}")
        asked_rows = self.spark.createDataFrame([(i, r.query_id, r.vector) for i, r in enumerate(asked)], f"nth int, query_id {queries.schema['query_id'].dataType.simpleString()}, q array<double>")
        met = near.select("cell", key, "vector").join(F.broadcast(pairs), ["cell", key]).join(F.broadcast(asked_rows), "nth")
        exact = met.select("query_id", key, F.round(1 - V.pair_cosine(F.col("vector"), F.col("q")), 9).alias("distance"))
        return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)


    def exact(self, q: list[float], k: int, among: DataFrame | None = None) -> DataFrame:
        """key, distance and rank of the k nearest rows, as if all vectors were read. among: keys that may be found."""
        model, key = self.model, self.key
        unit = np.array(q) / np.sqrt(np.dot(q, q))

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                if len(cell):
                    like = model.decoded(cell, np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)) @ unit
                    err = b.column("err").to_numpy() + SLACK
                    yield pa.RecordBatch.from_arrays([b.column("cell"), b.column(key), pa.array(like - err), pa.array(like + err)], names=["cell", key, "least", "most"])

        codes = self.rows.select("cell", key, "code", "err")
        codes = codes if among is None else codes.join(among.select(key), key, "left_semi").select("cell", key, "code", "err")
        bounds = codes.mapInArrow(bounded, f"cell int, {key} {self.kind}, least double, most double")
        best = bounds.select("least").orderBy(F.desc("least")).limit(k).collect()
        floor = best[-1].least if len(best) == k else -float("inf")
        open_ = bounds.where(F.col("most") >= floor).select("cell", key)
        near, few = self.rows.select("cell", key, "vector"), open_.limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            near = near.where(F.col("cell").isin(sorted({r.cell for r in few})) & F.col(key).isin([r[key] for r in few]))
        else:
            near = near.join(open_, ["cell", key], "left_semi")
        few = near.select(key, F.round(V.cosine_distance(F.col("vector"), [float(x) for x in q]), 9).alias("distance")).orderBy("distance", key).limit(k)
        return few.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


#: Over what rounding of products and of distances (to 9 digits) can change.
SLACK = 1e-8


def build(df: DataFrame, key: str, root: str, vector: str = "embedding", cells: int | None = None, parts: int = 128, coverage: float = 0.98, near: int = 20, seed: int = 42) -> Index:
    """Fits and writes an index of all rows below root; open_index reads it again. Keys are told apart by their value; cells: about the root of the rows, at most 4096."""
    spark = df.sparkSession
    rows = df.select(key, F.col(vector).alias("vector")).where(has_direction(F.col("vector")))
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    # By the key's hash: the same rows however the table is partitioned.
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLE).select("vector").toArrow()["vector"] if n else None
    dims = len(rows.first().vector) if n else 1
    parts = next(p for p in range(min(parts, dims), 0, -1) if dims % p == 0)
    if drawn is None or not len(drawn):
        model = Model(np.zeros((1, dims)), np.zeros((parts, 1, dims // parts)), 1)
    else:
        model = fitted(_units(drawn.combine_chunks(), dims), cells or max(1, min(4096, round(n**0.5 / 2))), parts, coverage, near, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(b.column("vector"), dims)
            cell, code = model.encoded(x)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("vector"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.sqrt(((x - model.decoded(cell, code)) ** 2).sum(1)))], names=[key, "vector", "cell", "code", "err"])

    kind, element = rows.schema[key].dataType.simpleString(), rows.schema["vector"].dataType.elementType.simpleString()
    coded = rows.mapInArrow(encode, f"{key} {kind}, vector array<{element}>, cell int, code binary, err double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(tasks, "cell", key).sortWithinPartitions("cell", key)
    # Small row groups: a few keys' vectors are read without their neighbours.
    dealt.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("cell").parquet(f"{root}/rows")
    spark.createDataFrame([(model.centres.tolist(), model.books.tolist(), model.probe, n, key, kind, element)], "centres array<array<double>>, books array<array<array<double>>>, probe int, n long, key string, kind string, element string").write.mode("overwrite").parquet(f"{root}/model")
    return Index(spark, root, key, kind, element, model, n)


def open_index(spark: SparkSession, root: str) -> Index:
    r = spark.read.parquet(f"{root}/model").first()
    return Index(spark, root, r.key, r.kind, r.element, Model(np.array(r.centres), np.array(r.books), r.probe), r.n)
