"""Near-duplicate documents by a chosen-path set-similarity join.

A document's set is its distinct word shingles (lower-cased A-Z, ASCII white space), hashed to 64 bits. Rows with
equal sets are one class. A class has `SIZE` minwise values. In each of `TREES` independent trees a class starts at the
root and, at every node, takes the children named by FAN minwise tokens that the node's own path selects, so
classes meet in a node only by agreeing on all the tokens of its path. Small nodes are compared exhaustively on
compact sketches (4 bits of every minwise value); nodes over LIMIT classes branch on. A pair at the least similarity 0.8
survives a tree of two levels with probability 0.95 and all four trees fail it once in 10**5.

Links are confirmed on full sets. What is wanted are the components, so the join goes in two passes:

1. Every class takes one promising partner of smaller id (nodes over LIMIT are dealt into random blocks that share
   a few pivots). These links are confirmed and joined into components: each group of copies falls together
   without emitting its pairs.
2. Every node is compared again, for pairs over the sketches' margin whose components differ. In large nodes only the
   classes outside of the largest component need a comparison with the rest; where these are many, the node
   branches on, and what is large after MORE_LEVELS is compared block by block. Components with such a pair form a cluster;
   a node only emits enough pairs to connect them. Then all full sets outside of a cluster's largest component meet
   all of the cluster, in blocks of bounded size, and again only links that join components are emitted. So no pair is
   dropped for size, and no group emits its pairs.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; with fewer words than a
shingle the whole sequence is the one shingle; null ids take part in nothing, their component_id is null and kept is
true; repeated rows fall into one class; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch

SIZE, TREES, FAN = 128, 4, 2
LIMIT, PIVOTS, MORE_LEVELS = 512, 8, 3
#: Sketched similarity from which a pair is confirmed (four deviations below 0.8), and from which it is likely.
MARGIN, LIKELY = 0.14, 0.06

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), U, len(w))
    if len(w) < words:
        words = len(w)
    out = np.full(len(w) - words + 1, U(words))
    with np.errstate(over="ignore"):
        for i in range(words):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(w) - words + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 63, SIZE, dtype=U) * U(2) + U(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minwise values."""
    least = np.full(SIZE, np.iinfo(U).max, U)
    for lo in range(0, len(s), 2048):
        np.minimum(least, (s[lo : lo + 2048, None] * multipliers()).min(axis=0), out=least)
    return ((least >> U(20)) & U(0xFFFF)).astype("<u2")


def sketch(sig: np.ndarray) -> np.ndarray:
    """4 bits of each value, two a byte."""
    low = (sig & 15).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << 4


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimate from sketches (as 64-bit words on the last axis), free of chance agreement."""
    x = a ^ b
    x |= x >> U(1)
    x |= x >> U(2)
    off = np.bitwise_count(x & U(0x1111111111111111)).sum(axis=-1, dtype=np.int32)
    return 1 - off / (SIZE * 15 / 16)


def hashed_sets(docs: DataFrame, words: int, text: str, id_col: str) -> DataFrame:
    """id, n_shingles, set_key (null for an empty set), sig."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                sets = [shingle_set(x, words) for x in b.column(text).to_pylist()]
                cols = [b.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_shingles", "set_key", "sig"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, sig binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def tree_nodes(reps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """node, id, the kept columns and sketch: every class at the second level of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column("sig"), "<u2")
            at = np.arange(len(sig))
            sk = pa.array([x.tobytes() for x in sketch(sig)], pa.binary())
            with np.errstate(over="ignore"):
                for tree in range(TREES):
                    for i in range(FAN):
                        c = (tree * FAN + i) * (SIZE // (TREES * FAN))
                        first = mix(sig[:, c].astype(U) + U((tree * FAN + i + 1) << 20))
                        for j in range(FAN):
                            pick = mix(first + U(j + 1)) % U(SIZE)
                            node = mix(first * U(31) + (pick << U(17)) + sig[at, pick.astype(np.int64)] + U(j))
                            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("id"), *(b.column(k) for k in keep), sk], names=["node", "id", *keep, "sketch"])

    kinds = "".join(f", {k} {reps.schema[k].dataType.simpleString()}" for k in keep)
    return reps.select("id", *keep, "sig").mapInArrow(run, f"node long, id long{kinds}, sketch binary")


def branch(rows: DataFrame) -> DataFrame:
    """The children of nodes further down: three pairs of sketched tokens each, so that 0.8 keeps branching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, sk = b.column("node").to_numpy().view(U), _matrix(b.column("sketch"), "u1")
            at = np.arange(len(sk))
            with np.errstate(over="ignore"):
                for j in range(3):
                    byte = (mix(node + U(j + 11)) % U(SIZE // 2)).astype(np.int64)
                    child = mix(node * U(37) + (byte.astype(U) << U(9)) + sk[at, byte] + U(j))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *b.columns[1:]], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 8192) -> Iterator[pa.Table]:
    """Whole groups of equal leading columns out of sorted batches, some thousands of rows at a time."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        k = [t.column(i).to_numpy() for i in range(keys)]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            e = edges(t)
            if len(e):
                yield t.slice(0, e[-1])
                t = t.slice(e[-1])
            held, rows = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _close_pairs(bounds: np.ndarray, sk: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i < j of the same group with an estimate of at least `least`."""
    size = np.diff(bounds)
    small = np.repeat(size <= 32, size)
    stop = np.repeat(bounds[1:], size)
    n = len(sk)
    for d in range(1, 32):
        i = np.flatnonzero(small[: n - d] & (np.arange(n - d) + d < stop[: n - d])) if n > d else np.zeros(0, np.int64)
        if not len(i):
            break
        est = similarity(sk[i], sk[i + d])
        ok = est >= least
        yield i[ok], i[ok] + d, est[ok]
    for lo, hi in zip(bounds[:-1][size > 32], bounds[1:][size > 32]):
        for at in range(lo, hi, 128):
            to = min(at + 128, hi)
            est = similarity(sk[at:to, None, :], sk[None, lo:hi, :])
            i, j = np.nonzero(est >= least)
            ok = i + at < j + lo
            yield i[ok] + at, j[ok] + lo, est[i[ok], j[ok]]


def partners(cells: DataFrame, threshold: float) -> DataFrame:
    """id, likely, other, est: a promising partner of smaller id for every class that has a close one in a cell; other is null where a class only has close ones of larger ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            ids, sk = t.column("id").to_numpy(), _matrix(t.column("sketch").combine_chunks(), "<u8")
            k1, k2 = t.column(0).to_numpy(), t.column(1).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1, [len(ids)]])
            found = list(_close_pairs(bounds, sk, threshold - MARGIN))
            if not found:
                continue
            i, j, est = (np.concatenate(x) for x in zip(*found))
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            ok = a != b
            a, b, est = a[ok], b[ok], est[ok]
            likely = est >= threshold + LIKELY
            order = np.lexsort((np.where(likely, 0, -est), np.where(likely, a, 0), ~likely, b))
            b1, first = np.unique(b[order], return_index=True)
            pick = order[first]
            low = np.setdiff1d(a, b1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([b1, low])), pa.array(np.concatenate([likely[pick], np.zeros(len(low), bool)])),
                pa.array([*a[pick].tolist(), *[None] * len(low)], pa.int64()), pa.array(np.concatenate([est[pick], np.zeros(len(low))])),
            ], names=["id", "likely", "other", "est"])

    return cells.mapInArrow(run, "id long, likely boolean, other long, est double")


def _joining(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray) -> np.ndarray:
    """Numbers of pairs that join all components which the pairs join: a forest."""
    low, high = np.minimum(comp_a, comp_b), np.maximum(comp_a, comp_b)
    _, first = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for i, x, y in zip(first.tolist(), low[first].tolist(), high[first].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            out.append(i)
    return np.array(out, np.int64)


def crossing(cells: DataFrame, threshold: float) -> DataFrame:
    """a, b: components of a cell that have a close pair, as a forest. role 0: compared with all of the cell; 1: with those of role 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            ids, comp, role = (t.column(c).to_numpy() for c in ("id", "comp", "role"))
            sk = _matrix(t.column("sketch").combine_chunks(), "<u8")
            k1, k2 = t.column(0).to_numpy(), t.column(1).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1, [len(ids)]])
            # Groups of one component have nothing to give.
            mixed = np.repeat(np.minimum.reduceat(comp, bounds[:-1]) != np.maximum.reduceat(comp, bounds[:-1]), np.diff(bounds))
            if not mixed.any():
                continue
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[mixed]
            ids, comp, role, sk = ids[mixed], comp[mixed], role[mixed], sk[mixed]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(ids)]])
            found = []
            for i, j, _ in _close_pairs(bounds, sk, threshold - MARGIN):
                ok = (comp[i] != comp[j]) & ((role[i] == 0) | (role[i] != role[j]))
                found.append((comp[i][ok], comp[j][ok]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                pick = _joining(a, b, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[pick]), pa.array(b[pick])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of 0-1 matrices over the values that both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    l_all, r_all = np.concatenate(left), np.concatenate(right)
    values = np.intersect1d(l_all, r_all)
    if not len(values):
        return out

    def places(sets: list[np.ndarray], every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(values, every)
        at[at == len(values)] = 0
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        ok = values[at] == every
        return row[ok], at[ok]

    (lr, lc), (rr, rc) = places(left, l_all), places(right, r_all)
    for lo in range(0, len(values), columns):
        n = min(columns, len(values) - lo)
        m, k = (lc >= lo) & (lc < lo + n), (rc >= lo) & (rc < lo + n)
        a, b = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        a[lr[m], lc[m] - lo] = 1
        b[rr[k], rc[k] - lo] = 1
        out += a @ b.T
    return out


def exact_crossing(cells: DataFrame, words: int, pct: int) -> DataFrame:
    """a, b: confirmed links between components of a cell, as a forest. Rows of role 1 meet those of role 2, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2, 256):
            k1, k2 = t.column(0).to_numpy(), t.column(1).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1, [len(k1)]])
            for lo, hi in zip(bounds, bounds[1:]):
                part = t.slice(lo, hi - lo)
                ids, comp, role = (part.column(c).to_numpy() for c in ("id", "comp", "role"))
                one, two = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
                if not len(one) or not len(two):
                    continue
                sets = [shingle_set(x, words) for x in part.column("text").to_pylist()]
                size = np.array([len(x) for x in sets])
                common = common_counts([sets[i] for i in one], [sets[j] for j in two])
                union = size[one][:, None] + size[two][None, :] - common
                i, j = np.nonzero((100 * common >= pct * union) & (common > 0) & (comp[one][:, None] != comp[two][None, :]))
                if len(i):
                    i, j = one[i], two[j]
                    pick = _joining(ids[i], ids[j], comp[i], comp[j])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i][pick]), pa.array(ids[j][pick])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, words: int, pct: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * |intersection| >= pct * |union|. docs: id, text; sizes: id, n_shingles."""
    bounded = (
        pairs.join(sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb")), "b")
        .where(f"100 * least(na, nb) >= {pct} * greatest(na, nb)").select("a", "b")
    )
    texts = bounded.join(docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, U)
        for b in batches:
            ok = []
            for x, y in zip(b.column("ta"), b.column("tb")):
                x = x.as_py()
                if x != last:
                    last, held = x, shingle_set(x, words)
                other = shingle_set(y.as_py(), words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(both > 0 and 100 * both >= pct * (len(held) + len(other) - both))
            keep = b.filter(pa.array(ok, pa.bool_()))
            yield keep.select(["a", "b"])

    return texts.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, comp for every id with an edge (a, b): the smallest id reachable. Alternating large and small stars."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for i in range(1, 100):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = scratch.keep(small.where("u <> v").distinct(), f"{name}_{i}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components have not settled after 100 rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())


def _cells(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "id")


def near_duplicates(docs: DataFrame, *, words: int = 5, pct: int = 80, text: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of docs. Ids are whole numbers, of one text each; tables whose ids repeat need a row number for id (see the pipeline)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    threshold = pct / 100
    sets = scratch.keep(hashed_sets(docs, words, text, id_col).withColumn("id", F.col("id").cast("long")), "sets")
    usable = sets.where("id IS NOT NULL AND set_key IS NOT NULL")
    classes = scratch.keep(usable.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.keep(usable.join(classes, "set_key").where("id = rep").select("id", "n_shingles", "sig").dropDuplicates(["id"]), "reps")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sizes = reps.select("id", "n_shingles")

    # Pass 1: one promising partner each.
    nodes = tree_nodes(reps)
    big = scratch.keep(nodes.groupBy("node").count().where(F.col("count") > LIMIT).select("node", F.col("count").alias("n")), "big_nodes")
    there = nodes.join(big, "node", "left")
    n_blocks = F.ceil(F.col("n") / LIMIT).cast("int")
    lot = F.xxhash64("id", "node")
    blocks = F.when(F.col("n").isNull(), F.array(F.lit(0))).when(F.pmod(lot, F.col("n")) < PIVOTS, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array(F.pmod(F.shiftright(lot, 20), n_blocks).cast("int")))
    dealt = there.select("node", F.explode(blocks).alias("block"), "id", "sketch")
    best = F.min(F.struct(F.col("other").isNull().alias("none"), (~F.col("likely")).alias("unlikely"), F.when(F.col("likely"), F.col("other")).otherwise(F.lit(0)).alias("low"), (-F.col("est")).alias("far"), "other")).alias("best")
    close = scratch.keep(partners(_cells(dealt, "node", "block"), threshold).groupBy("id").agg(best).select("id", F.col("best.other").alias("other")), "partners")
    tried = close.where("other IS NOT NULL").select(F.col("other").alias("a"), F.col("id").alias("b"))
    links = scratch.keep(confirmed(tried, texts, sizes, words, pct).distinct(), "links_1")
    joined = scratch.keep(components(links, scratch, "first"), "components_1")

    # Pass 2: what is still apart. Classes without a close one in small nodes are done.
    marked = reps.join(close.select("id", F.lit(True).alias("close")), "id", "left").join(joined, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.coalesce("close", F.lit(False)).alias("close"), "sig")
    again = tree_nodes(marked, ("comp", "close")).join(big, "node", "left")
    small = again.where("n IS NULL AND close").select("node", F.lit(0).cast("long").alias("cell"), "id", "comp", F.lit(0).alias("role"), "sketch")
    apart = [crossing(_cells(small, "node", "cell"), threshold)]
    rows = again.where("n IS NOT NULL").select("node", "id", "comp", "sketch") if big.limit(1).count() else None
    for level in range(MORE_LEVELS + 1):
        if rows is None:
            break
        rows = scratch.keep(rows, f"level_{level}")
        stats = rows.groupBy("node", "comp").count().groupBy("node").agg(F.sum("count").alias("n"), F.max("count").alias("largest"), F.max_by("comp", F.struct("count", "comp")).alias("main")).where("largest < n")
        mixed = rows.join(scratch.keep(stats, f"stats_{level}"), "node").withColumn("others", F.col("n") - F.col("largest"))
        last = level == MORE_LEVELS
        done = mixed if last else mixed.where(F.col("others") <= LIMIT)
        apart.append(crossing(_cells(_grid(done), "node", "cell"), threshold))
        rest = None if last else mixed.where(F.col("others") > LIMIT).select("node", "id", "comp", "sketch")
        rows = branch(rest) if rest is not None and rest.limit(1).count() else None
    near = apart[0]
    for x in apart[1:]:
        near = near.union(x)
    clusters = components(near, scratch, "clusters").select(F.col("id").alias("comp"), F.col("comp").alias("node"))
    members = reps.select("id", "n_shingles").join(joined, "id", "left").select("id", "n_shingles", F.coalesce("comp", "id").alias("comp")).join(clusters, "comp")
    members = scratch.keep(members, "members")
    # A block's weight is its rows or its shingles by 256, whichever is more.
    weight = F.ceil(F.greatest(F.sum("rows").cast("double"), F.sum("weight") / 256)).cast("long")
    per_comp = members.groupBy("node", "comp").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("weight"))
    stats = per_comp.groupBy("node").agg(weight.alias("n"), F.max_by(F.struct("rows", "weight"), F.struct("rows", "comp")).alias("most"), F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))
    others = F.greatest(F.ceil(F.greatest((F.col("rows") - F.col("most.rows")).cast("double"), (F.col("weight") - F.col("most.weight")) / 256)), F.lit(1)).cast("long")
    mixed = members.join(scratch.keep(stats.select("node", "n", "main", others.alias("others")), "cluster_stats"), "node").join(texts, "id")
    more = scratch.keep(exact_crossing(_cells(_grid(mixed, "text"), "node", "cell"), words, pct).distinct(), "links_2")
    final = components(links.union(more), scratch, "second") if more.limit(1).count() else joined

    of_class = classes.join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    out = sets.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    comp = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _grid(mixed: DataFrame, what: str = "sketch") -> DataFrame:
    """Cells of a large group: blocks of its classes outside of the largest component (role 1) against blocks of all its classes (role 2)."""
    lot = F.xxhash64("id", "node")
    across, down = F.ceil(F.col("n") / LIMIT).cast("int"), F.ceil(F.col("others") / LIMIT).cast("int")
    own, mine = F.pmod(lot, across).cast("int"), F.pmod(F.shiftright(lot, 20), down).cast("int")
    # One row a class and role, then one a cell: the wide column is read once.
    every = F.transform(F.sequence(F.lit(0), down - 1), lambda i: F.struct((i * across + own).cast("long").alias("cell"), F.lit(2).alias("role")))
    few = F.transform(F.sequence(F.lit(0), across - 1), lambda j: F.struct((mine * across + j).cast("long").alias("cell"), F.lit(1).alias("role")))
    cells = F.concat(every, F.when(F.col("comp") != F.col("main"), few).otherwise(F.array().cast("array<struct<cell:bigint,role:int>>")))
    return mixed.select("node", F.explode(cells).alias("x"), "id", "comp", what).select("node", "x.cell", "id", "comp", "x.role", what)
