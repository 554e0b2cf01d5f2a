"""Exact inner-product top-k by pivot-table elimination.

Vectors become integers. A few pivots are chosen (farthest-first on a bounded sample) and every vector's
distances to all pivots are computed once, with the vector. For a query q and a candidate x the largest
|d(q,p) - d(x,p)| over the pivots p is a lower bound of d(q,x), so (|q|^2 + |x|^2 - bound^2) / 2 is an upper
bound of their inner product. Candidates are evaluated in the order of their bounds, and a query stops once
k scores are at or over every bound that is left (bounds equal to the k-th score are still evaluated, for ties).

Plan: rows are packed into blocks of vectors with their pivot table, which are written once; the stated query set is
packed likewise. The blocks are dealt into parts of bounded size, and the queries (the few) are copied to the parts, not the candidates to the queries:
what is shuffled is the candidates once and the queries once a part. A task holds one part, meets one block of queries after the other
with all of its blocks, and carries each query's k-th score from block to block; it begins with the k-th score among the
pivots' sample, whose rows are candidates themselves. A part leaves at most k rows for a query, of which a window keeps the best k.
A hot vector or id is spread like any other rows, as parts are dealt by block number. (While there are fewer parts than tasks, each part is copied for some shares of the queries.)

Defined cases: vectors that are null, or hold null or non-finite components, take no part; an empty vector scores 0;
of vectors of unlike lengths the missing components count as 0; null ids take no part; repeated rows are candidates
each, but a query is asked once for an id; ties go to the smaller id; an empty table gives no rows. Scores are exact
while sums of products stay below 2**53; beyond, Python's integers are used and scores saturate at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: What a part of the candidates takes in a task.
PART_BYTES = 48 << 20
SPACE = 1 << 40
LARGEST = (1 << 63) - 1


def quantised(lists: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of usable vectors, as float64 (exact below 2**53)."""
    out: list[np.ndarray | None] = []
    for x in lists:
        v = None if not x.is_valid else x.values
        if v is None or v.null_count:
            out.append(None)
            continue
        a = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
        out.append(a if np.isfinite(a).all() else None)
    return out


def stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight differences, one pivot at a time: no cancellation."""
    return np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(m), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first; stops early when every vector of the sample is a pivot."""
    if not len(sample):
        return sample
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def best_of_block(q_ids, q, q_piv, x_ids, x, x_piv, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row numbers, candidate ids and scores of each query's best k here, and how many scores were computed. Candidates whose bound is below a query's floor are not wanted."""
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if max(q2.max(initial=0), x2.max(initial=0)) >= 2**52:
        return best_of_wide(q_ids, q, x_ids, x, k)
    x_len = np.sqrt(x2)
    rows, ids, scores, done = [], [], [], 0
    for i in range(len(q_ids)):
        low = np.zeros(len(x_ids))
        for p in range(q_piv.shape[1]):
            np.maximum(low, np.abs(x_piv[:, p] - q_piv[i, p]), out=low)
        # Rounding of the distances is below one part in 10**12; the slack keeps the bound safe.
        low = np.maximum(0, low - 1e-9 * (1 + np.sqrt(q2[i]) + x_len))
        bound = (q2[i] + x2 - low * low) / 2 + 1
        own = x_ids == q_ids[i]
        bound[own] = -np.inf
        least = -np.inf if floor is None else floor[i]
        n, first = len(bound), 16 * k
        at = np.flatnonzero(bound >= least) if least > -np.inf else np.arange(n)
        if len(at) > first:
            at = at[np.argpartition(-bound[at], first)[:first]]
        at = at[~own[at]]
        have_ids, have = x_ids[at], x[at] @ q[i]
        done += len(at)
        keep = best(have, have_ids, k)
        have_ids, have = have_ids[keep], have[keep]
        bound[at] = -np.inf
        limit = lambda have: max(least, have[-1] if len(have) == k else -np.inf)
        rest = np.flatnonzero((bound >= limit(have)) & (bound > -np.inf))
        if len(rest):
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            step = 64
            while len(rest) and bound[rest[0]] >= limit(have):
                at, rest = rest[:step], rest[step:]
                have_ids, have = np.concatenate([have_ids, x_ids[at]]), np.concatenate([have, x[at] @ q[i]])
                done += len(at)
                keep = best(have, have_ids, k)
                have_ids, have = have_ids[keep], have[keep]
                step *= 2
        rows.append(np.full(len(have), i))
        ids.append(have_ids)
        scores.append(have)
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
    return cat(rows).astype(np.int64), cat(ids).astype(np.int64), np.rint(cat(scores)).astype(np.int64), done


def best_of_wide(q_ids, q, x_ids, x, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same by whole numbers of any size, for components too large for exact floats."""
    rows, ids, scores = [], [], []
    xs = [[int(v) for v in row] for row in x]
    for i, row in enumerate(q):
        a = [int(v) for v in row]
        got = sorted((-min(max(sum(map(int.__mul__, a, b)), -LARGEST - 1), LARGEST), int(j)) for b, j in zip(xs, x_ids) if j != q_ids[i])[:k]
        rows += [i] * len(got)
        ids += [j for _, j in got]
        scores += [-s for s, _ in got]
    return np.array(rows, np.int64), np.array(ids, np.int64), np.array(scores, np.int64), len(q) * len(x)


def merged(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of what was found."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


class Part:
    """The blocks of candidates that one task holds."""

    def __init__(self, k: int):
        self.k, self.blocks = k, []

    def add(self, ids, vectors, table) -> None:
        self.blocks.append((ids, vectors, table))

    def best(self, q_ids, q, q_piv, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query row numbers, candidate ids, scores, and how many scores were computed."""
        floor, done = floor.copy(), 0
        rows, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        for x_ids, x, x_piv in self.blocks:
            more_rows, more_ids, more_scores, n = best_of_block(q_ids, q, q_piv, x_ids, x, x_piv, self.k, floor)
            done += n
            rows, ids, scores = merged(np.concatenate([rows, more_rows]), np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores]), self.k)
            last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == self.k - 1)
            floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
        return rows, ids, scores, done


def floors(q_ids, q, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the sample's rows but its own; -inf where these are fewer, or too large for exact floats."""
    out = np.full(len(q_ids), -np.inf)
    if len(sample) <= k or max((q * q).sum(axis=1).max(initial=0), (sample * sample).sum(axis=1).max(initial=0)) >= 2**52:
        return out
    score = np.where(sample_ids[None, :] == q_ids[:, None], -np.inf, q @ sample.T)
    return np.partition(score, -k, axis=1)[:, -k]


def packed(rows: DataFrame, pivots: np.ndarray, scale: float, width: int, block_rows: int) -> DataFrame:
    """Blocks of at most block_rows vectors of a partition: n, ids, vectors, pivot table (little-endian bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
            m = stacked(vectors, width)
            cols = [np.array(ids, np.int64).tobytes(), m.astype("<f8").tobytes(), distances(m, pivots).astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["n", "ids", "vectors", "table"])

        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), quantised(b.column(1), scale)):
                if i is not None and v is not None:
                    ids.append(i)
                    vectors.append(v)
                if len(ids) == block_rows:
                    yield block(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield block(ids, vectors)

    return rows.mapInArrow(run, "n long, ids binary, vectors binary, table binary")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, n_pivots: int = 32, pivot_sample: int = 2000, id_col: str = "vec_id", vector: str = "embedding", scratch=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among all rows but its own.

    pivot_sample bounds the rows that pivots are chosen from and that give the first floors (smallest hashes of their ids); they only steer speed.
    """
    from siftlake.llm.common import Scratch

    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asked")).where("id IS NOT NULL AND v IS NOT NULL")
    width, n_rows = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    # Rows with low hashes: few more than the sample ever leave their tasks.
    place = F.pmod(F.xxhash64("id"), F.lit(SPACE))
    some = rows.where(place < int(SPACE * (pivot_sample + 8 * pivot_sample**0.5) / n_rows)) if n_rows > 2 * pivot_sample else rows
    sample_ids, sample = [], []
    for b in some.orderBy(place, "id").limit(pivot_sample).select("id", "v").toArrow().to_batches():
        for i, v in zip(b.column(0).to_pylist(), quantised(b.column(1), scale)):
            if v is not None:
                sample_ids.append(i)
                sample.append(v)
    known_ids, known = np.array(sample_ids, np.int64), stacked(sample, width)
    pivots = choose_pivots(known, n_pivots)
    numbered = lambda df: df.withColumn("no", F.monotonically_increasing_id())
    blocks = scratch.keep(numbered(packed(rows.select("id", "v"), pivots, scale, width, BLOCK_ROWS)), "blocks")
    # A stated set: ids are spread anew, so that query blocks are full and many tasks make them.
    asked = rows.where(F.coalesce("asked", F.lit(False))).groupBy("id").agg(F.min_by("v", F.to_json(F.struct("v"))).alias("v"))
    queries = scratch.keep(numbered(packed(asked, pivots, scale, width, QUERY_ROWS)), "queries")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_rows = max(BLOCK_ROWS, PART_BYTES // (8 * (width + n_pivots)))
    parts = max(-(-n_rows // part_rows), min(tasks, -(-n_rows // BLOCK_ROWS)), 1)
    shares = max(1, min(tasks // parts, queries.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = ("no", "n", "ids", "vectors", "table")
    held = blocks.select(F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("part"), every(shares).alias("share"), F.lit(0).alias("asks"), *data)
    asking = queries.select(every(parts).alias("part"), F.pmod(F.xxhash64("no"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("asks"), *data)
    cells = held.union(asking).repartition(max(tasks, parts * shares), "part", "share").sortWithinPartitions("part", "share", "asks", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, part = None, Part(k)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if (r["part"], r["share"]) != cell:
                    cell, part = (r["part"], r["share"]), Part(k)
                ids = np.frombuffer(r["ids"], np.int64)
                vectors, table = _mat(r["vectors"], len(ids)), _mat(r["table"], len(ids))
                if not r["asks"]:
                    part.add(ids, vectors, table)
                    continue
                at, found, scores, _ = part.best(ids, vectors, table, floors(ids, vectors, known_ids, known, k))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _mat(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(n, -1)
