"""Sampled segmentations without replacement (Gumbel top-k), and decoding.

The k segmentations of a text with the highest perturbed log probabilities are drawn by a perturbed best-first (A*)
search. A subtree of the lattice's search tree is a prefix with some next pieces excluded; the exact log
mass of its leaves (from the lattices' backward sums) is the location of the Gumbel that is their maximum, truncated at
its parent's. The root's maximum belongs to a leaf drawn forwards; what is left of the subtree are the siblings of the leaf's steps,
and a run of steps is one region of the search: its mass is the difference of two prefix probabilities, so its truncated maximum needs one
number. The region of the highest maximum gives the next leaf: the step where it leaves is drawn by mass, then its edge there, then the rest
forwards; the region falls apart into the steps before, those after, the step's other edges and the new leaf's own siblings.
So each leaf costs its length, and the leaves come out in the order of their perturbed scores, distinct. All masses are logarithms, and a region in which
nearly nothing is left sums its siblings' masses one by one, so the least likely segmentation comes out too.

The inclusion score of a sample is the probability that its perturbed score exceeds the (k+1)-th one:
1 - exp(-exp(log p - threshold)), 1 if there is no further segmentation.

Random numbers are hashes of (seed, row key, sample, place), so they do not depend on batches or tasks.
Probabilities are proportional to exp(alpha * summed scores).

Defined cases: null and empty texts have one segmentation without pieces, of probability 1; a text with fewer than k segmentations
returns all it has; a very long text is handled alone, in memory in proportion to it; a null key is seeded as 0; repeated rows (equal keys and texts) return equal samples; an empty table
gives an empty result; extra columns are not read. Decoding returns the text but for the word mark itself, which turns into a blank.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.lattice import build_by_start, conditionals, vocabulary

#: Characters of text handled at once; a longer text is handled alone. A worker's memory is in proportion to them, and to the store's edges.
CHARS = 400_000
#: Edges of a worker's store from which it starts anew, and characters of cuts learnt at once.
EDGES, LEARNT = 2_000_000, 200_000
U = np.uint64


def _hash(x: np.ndarray) -> np.ndarray:
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _mixed(seed: np.ndarray, *names) -> np.ndarray:
    with np.errstate(over="ignore"):
        for n in names:
            seed = _hash(seed ^ _hash(np.asarray(n).astype(U)))
    return seed


def uniform(seed: np.ndarray, *names) -> np.ndarray:
    """In (0, 1), by the seeds (uint64) and whole numbers."""
    return ((_mixed(seed, *names) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


class Grown:
    """An array that grows in place; pages not written yet take no memory."""

    def __init__(self, kind: str, room: int):
        self.held, self.n = np.empty(room, kind), 0

    def add(self, x: np.ndarray) -> np.ndarray:
        if self.n + len(x) > len(self.held):
            more = np.empty(self.n + max(self.n, len(x)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)
        return self.held[: self.n]


class Numbers(dict):
    """Numbers of cuts, from 0; an unseen one gets the next."""

    def __missing__(self, cut: str) -> int:
        self[cut] = n = len(self)
        return n


class Store:
    """Lattices of the cuts met so far, in one set of arrays; full, it starts anew. Nodes and edges are numbered through all cuts.

    Edges lie by their start node: those of node n are low[n] to low[n + 1] - 1, and cum holds their running probabilities (infinite at the last).
    """

    PARTS = {"first": "i8", "last": "i8", "start": "i4", "end": "i4", "piece": "i4", "logp": "f8", "cum": "f8", "low": "i8"}

    def __init__(self, path: str, alpha: float, edges: int = EDGES):
        self.v, self.alpha, self.most = vocabulary(path), alpha, edges
        self.clear()

    def clear(self) -> None:
        self.number, self.chunks = Numbers(), []
        self.held = {k: Grown(t, self.most) for k, t in self.PARTS.items()}
        for k in self.PARTS:
            setattr(self, k, self.held[k].add(np.zeros(int(k == "low"), np.int64)))

    def numbers(self, cuts: list[list[str]]) -> np.ndarray:
        """Of the cuts in their order; those not met yet are learnt."""
        if len(self.start) > self.most:
            self.clear()
        out = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(cuts)), np.int64, sum(map(len, cuts)))
        part, chars = [], 0
        for cut in list(itertools.islice(self.number, len(self.chunks), None)):
            part.append(cut)
            chars += len(cut)
            if chars >= LEARNT:
                self._learn(part)
                part, chars = [], 0
        if part:
            self._learn(part)
        return out

    def _learn(self, new: list[str]) -> None:
        lat, low = build_by_start(self.v, new)
        logp = conditionals(lat, low, self.alpha)
        nodes, edges = len(self.low) - 1, len(self.start)
        low = low[: len(lat.text) + 1]
        # Running sums node by node (one place of all nodes at a time), so that a cut's numbers never depend on its company.
        cum, width = np.exp(logp), np.diff(low)
        at, i = np.flatnonzero(width > 1), 1
        while len(at):
            cum[low[at] + i] += cum[low[at] + i - 1]
            i += 1
            at = at[width[at] > i]
        cum[low[1:][width > 0] - 1] = np.inf
        self.chunks += new
        self.held["low"].n -= 1  # the end of all is written again
        fresh = {"first": lat.first + nodes, "last": lat.last + nodes, "start": lat.start + nodes, "end": lat.end + nodes, "piece": lat.piece, "logp": logp, "cum": cum, "low": low + edges}
        for k, x in fresh.items():
            setattr(self, k, self.held[k].add(x))


_stores: dict[tuple[str, float], Store] = {}


#: A region that keeps less than a thousandth of its mass sums its siblings: the difference of prefixes would lose digits.
NEARLY = -1e-3


def _logsum(x: np.ndarray) -> float:
    top = x.max(initial=-np.inf)
    return float(top + np.log(np.exp(x - top).sum())) if top > -np.inf else -np.inf


def _drawn(logs: np.ndarray, u: float) -> int:
    """A place by its log weight."""
    run = np.cumsum(np.exp(logs - logs.max()))
    return min(int(np.searchsorted(run, u * run[-1], side="right")), len(logs) - 1)


def _truncated(g: float, mass: float, left: float) -> float:
    """The maximum of a region of this log mass, given that it is at most g; left: an exponential number."""
    return float(-np.logaddexp(-g, -mass + math.log(left)))


class Sampler:
    """The texts of one batch."""

    def __init__(self, path: str, texts: list[str], keys: list[int | None], alpha: float, seed: int):
        self.lat = lat = _stores.setdefault((path, alpha), Store(path, alpha))
        self.v = lat.v
        cuts = [self.v.chunks(x) for x in texts]
        counts = np.array([len(x) for x in cuts], np.int64)
        self.chunk = lat.numbers(cuts)
        self.chunks, self.logp, self.low, self.cum, self.n = lat.chunks, lat.logp, lat.low, lat.cum, len(texts)
        with np.errstate(over="ignore"):
            self.seed = _hash(np.array([(k or 0) & (1 << 64) - 1 for k in keys], U) ^ _hash(np.full(self.n, seed, U)))
        self.doc = np.repeat(np.arange(self.n), counts)
        size = (lat.last - lat.first)[self.chunk]
        at = np.cumsum(size) - size
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        per_doc = np.concatenate([at, [size.sum()]])[self.begin[:-1]]
        self.place = at - np.repeat(per_doc, counts)  # of each cut in its text

    def draw(self, occ: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Walks from a node of each occurrence of a cut to its end; occurrence and edge of every step, in text order."""
        occs, edges = [], []
        last, seed = self.lat.last[self.chunk[occ]], _mixed(self.seed, sample)[self.doc[occ]]
        shift = self.place[occ] - self.lat.first[self.chunk[occ]]
        while len(alive := np.flatnonzero(node < last)):
            if len(alive) < len(occ):
                occ, node, last, seed, shift = occ[alive], node[alive], last[alive], seed[alive], shift[alive]
            e = self.pick(node, uniform(seed, shift + node))
            occs.append(occ)
            edges.append(e)
            node = self.lat.end[e].astype(np.int64)
        if not occs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Step s of an occurrence goes to the s-th place of its own: no sort.
        count = np.zeros(len(self.chunk) + 1, np.int64)
        for o in occs:
            count[o] += 1
        at = np.cumsum(count) - count
        out_o, out_e = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        for i, (o, e) in enumerate(zip(occs, edges)):
            out_o[at[o] + i], out_e[at[o] + i] = o, e
        return out_o, out_e

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The first edge of the node whose running sum is over u; each round only looks at nodes that are still searched."""
        e = self.low[node]
        more = np.flatnonzero(self.cum[e] <= u)
        while len(more):
            e[more] += 1
            more = more[self.cum[e[more]] <= u[more]]
        return e

    def top(self, k: int) -> tuple[list[list[tuple[np.ndarray, np.ndarray, float, float]]], list[float]]:
        """For each text its samples (occurrences, edges, log probability, perturbed score) and the threshold, -inf if nothing is left."""
        got: list[list] = [[] for _ in range(self.n)]
        reach: list[list[np.ndarray]] = [[] for _ in range(self.n)]  # log probability of every prefix of a sample
        heap: list[list[tuple]] = [[] for _ in range(self.n)]  # regions: (maximum, sample, first step, last step + 1, edges excluded there or None)
        root = -np.log(-np.log(uniform(self.seed, 1 << 40)))
        occ, edge = self.draw(np.arange(len(self.chunk)), self.lat.first[self.chunk], 0)
        none = np.zeros(0, np.int64)
        picks = [(d, none, none, np.zeros(1), root[d]) for d in range(self.n)]
        for sample in range(k):
            left = -np.log(uniform(self.seed[:, None], sample, 1 << 43, np.arange(4)))  # exponential, for up to four new regions of a text
            if sample:
                todo = [d for d in range(self.n) if heap[d]]
                if not todo:
                    break
                u = uniform(self.seed[:, None], sample, 1 << 41, np.arange(2))
                picks, starts, nodes = [], [], []
                for d in todo:
                    best = max(heap[d], key=lambda x: x[0])
                    heap[d].remove(best)
                    g, of, a, b, out = best
                    (o, e, _, _), cum = got[d][of], reach[d][of]
                    step = a if out else self._step(cum, e, a, b, u[d, 0])
                    free = self._free(e[step], out or (int(e[step]),))
                    i = _drawn(self.logp[free], u[d, 1])
                    if not out:
                        self._region(heap[d], g, left[d, 0], of, cum, e, a, step)
                        self._region(heap[d], g, left[d, 1], of, cum, e, step + 1, b)
                    if len(free) > 1:  # the step stays open for its other edges
                        rest = np.delete(self.logp[free], i)
                        heap[d].append((_truncated(g, cum[step] + _logsum(rest), left[d, 2]), of, step, step + 1, (*(out or (int(e[step]),)), int(free[i]))))
                    # What follows the new edge: the rest of its cut, then all later cuts of the text.
                    after = np.arange(o[step], self.begin[d + 1])
                    n = self.lat.first[self.chunk[after]]
                    n[0] = self.lat.end[free[i]]
                    starts.append(after)
                    nodes.append(n)
                    picks.append((d, o[: step + 1], np.append(e[:step], free[i]), np.append(cum[: step + 1], cum[step] + self.logp[free[i]]), g))
                occ, edge = self.draw(np.concatenate(starts), np.concatenate(nodes), sample)
            docs, doc, lp = np.array([x[0] for x in picks], np.int64), self.doc[occ], self.logp[edge]
            for (d, o, e, cum, g), x, y in zip(picks, np.searchsorted(doc, docs).tolist(), np.searchsorted(doc, docs, side="right").tolist()):
                e, cum = np.concatenate([e, edge[x:y]]), np.concatenate([cum, cum[-1] + np.cumsum(lp[x:y])])
                got[d].append((np.concatenate([o, occ[x:y]]), e, float(cum[-1]), float(g)))
                reach[d].append(cum)
                self._region(heap[d], g, left[d, 3], sample, cum, e, len(o), len(e))
        return got, [max((x[0] for x in h), default=-np.inf) for h in heap]

    def _free(self, edge: int, out: tuple[int, ...]) -> np.ndarray:
        """The edges beside this one that are not excluded."""
        node = self.lat.start[edge]
        every = np.arange(self.low[node], self.low[node + 1])
        return every[[x not in out for x in every.tolist()]]

    def _beside(self, cum: np.ndarray, e: np.ndarray, a: int, b: int) -> np.ndarray:
        """Log masses of the siblings of each step from a to b."""
        node = self.lat.start[e[a:b]]
        out = np.full(b - a, -np.inf)
        for i in np.flatnonzero(self.low[node + 1] - self.low[node] > 1).tolist():
            out[i] = cum[a + i] + _logsum(self.logp[self._free(e[a + i], (int(e[a + i]),))])
        return out

    def _region(self, heap: list, g: float, left: float, of: int, cum: np.ndarray, e: np.ndarray, a: int, b: int) -> None:
        """Adds the region of steps a to b with its maximum, unless it is empty."""
        if b > a:
            gone = cum[b] - cum[a]
            mass = cum[a] + math.log(-math.expm1(gone)) if gone < NEARLY else _logsum(self._beside(cum, e, a, b))
            if mass > -np.inf:
                heap.append((_truncated(g, mass, left), of, a, b, None))

    def _step(self, cum: np.ndarray, e: np.ndarray, a: int, b: int, u: float) -> int:
        """The step of a region where the next leaf leaves, by mass."""
        gone = cum[b] - cum[a]
        if gone >= NEARLY:
            return a + _drawn(self._beside(cum, e, a, b), u)
        at = a + int(np.searchsorted(-cum[a + 1 : b + 1], -(cum[a] + math.log1p(u * math.expm1(gone)))))
        at = min(at, b - 1)
        while at > a and self.logp[e[at]] == 0:  # rounding must not end at a step without a sibling
            at -= 1
        return at

    def ids(self, occ: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Piece ids; an unknown becomes the bytes of its character, or the unknown id in vocabularies without bytes."""
        piece = self.lat.piece[edge]
        bad = np.flatnonzero(piece < 0)
        if not len(bad):
            return piece
        parts, last = [], 0
        for i in bad.tolist():
            c = self.chunk[occ[i]]
            char = self.chunks[c][self.lat.start[edge[i]] - self.lat.first[c]]
            spelt = [self.v.byte_ids[x] for x in char.encode("utf-8", "replace")] if self.v.byte_ids else [self.v.unknown_id]
            parts += [piece[last:i], np.array(spelt, np.int64)]
            last = i + 1
        return np.concatenate([*parts, piece[last:]])


def sample_segmentations(docs: DataFrame, model: str, *, k: int = 2, alpha: float = 1e-3, seed: int = 1, text: str = "text", id_col: str = "doc_id", verify: bool = False) -> DataFrame:
    """id_col, sample (from 1, by falling perturbed score), ids (little-endian 32-bit), n_tokens, log_prob, score, inclusion, and with verify round_trip: whether decoding the ids returns the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from sampled(batches)
        finally:
            _stores.clear()  # a worker that waits for its next task holds no lattices

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = [x or "" for x in b.column(text).to_pylist()], b.column(id_col).to_pylist()
            decode = decoder(model) if verify else None
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < CHARS):
                    chars += len(texts[hi])
                    hi += 1
                s = Sampler(model, texts[lo:hi], [k_ if isinstance(k_, int) else zlib.crc32(str(k_).encode()) if k_ is not None else None for k_ in keys[lo:hi]], alpha, seed)
                got, threshold = s.top(k)
                rows = [(i, j + 1, s.ids(o, e), lp, g, 1.0 if t == -np.inf else float(-np.expm1(-np.exp(min(lp - t, 50.0))))) for i, (x, t) in enumerate(zip(got, threshold)) for j, (o, e, lp, g) in enumerate(x)]
                raw = [r[2].astype("<u4").tobytes() for r in rows]
                same = [decode(x) == texts[lo + r[0]].replace("▁", " ") for x, r in zip(raw, rows)] if verify else []
                cols = [b.column(id_col).take(pa.array([lo + r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.array(raw, pa.binary()), pa.array([len(r[2]) for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)] + [pa.array(same, pa.bool_())] * verify, names=[id_col, "sample", "ids", "n_tokens", "log_prob", "score", "inclusion", *["round_trip"] * verify])
                lo = hi

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, sample int, ids binary, n_tokens long, log_prob double, score double, inclusion double" + ", round_trip boolean" * verify)


def decoded(samples: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The kept columns and the decoded text of `ids`."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([samples.schema[c] for c in keep]).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(map(decode, b.column("ids").to_pylist()), pa.string())], names=[*keep, "text"])

    return samples.select(*keep, *([] if "ids" in keep else ["ids"])).mapInArrow(run, schema)


def digest(samples: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The samples with ids_crc32 in place of their ids."""
    rounded = [F.round(c, 6).alias(c) for c in ("log_prob", "inclusion")]
    return samples.select(id_col, "sample", "n_tokens", *rounded, F.crc32("ids").alias("ids_crc32"), "round_trip")


def decoder(model: str):
    """Of 32-bit ids: pieces' bytes are joined and read as UTF-8, marks turn into blanks and the first one goes."""
    v = vocabulary(model)
    own = {i: bytes([b]) for b, i in v.byte_ids.items()}
    raw = [own.get(i) or p.replace("▁", " ").encode("utf-8") for i, p in enumerate(v.pieces)]
    size = np.array([len(x) for x in raw])
    first, every = np.cumsum(size) - size, np.frombuffer(b"".join(raw), "u1")

    def decode(ids: bytes) -> str:
        i = np.frombuffer(ids, "<u4")
        n = size[i]
        stop = np.cumsum(n)
        out = every[np.repeat(first[i] - stop + n, n) + np.arange(n.sum())].tobytes()
        return out[out[:1] == b" " :].decode("utf-8", "replace")

    return decode
