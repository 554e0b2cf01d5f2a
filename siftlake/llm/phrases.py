"""Phrases of two to four words that hold together, by language: counts of word sequences, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words. f counts the occurrences of a sequence within pieces. A
candidate (2 to 4 words, a = f of at least `least`) is cut after each of its first words; the cut of the lowest floor(2000000 * a / (l + r)), with l and r the
counts of both sides, is its score. A candidate inside of a longer one that makes up 80 % of its occurrences is dropped.

Plan: each task reads its texts into shards of some million words and counts a shard's sequences in a trie of DEPTH levels, under the language: a level is
sorted by the number of the parent node and the word's rank, so that the trie comes out in the order of its words. Tries are serialised, cut at
boundaries (language, first word, second word) and sent to the task of each range; there the sorted runs are merged. Sequences are so counted before they are
shuffled, and a frequent sequence is one node a shard. Where the words under one first word lie in several ranges, each gets its count.
The walk down the merged trie gives the counts of a sequence's left parts. Only sequences of `least` occurrences leave the task; a right part is
the sequence's suffix and has as many occurrences at least, so an equi-join of the kept ones follows the suffix links.

The boundaries come from a sample of about SAMPLE texts and at most KEYS sequences of each; they decide which task counts what, never what is counted.

Defined cases: null text is empty; a null language is `und`; texts without words add nothing; ties of score and count are ordered by the bytes of the phrase;
repeated rows count each; an empty table gives no rows; very long texts are read whole; other columns are not read, whatever they are named.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, placed

DEPTH = 4
#: Words of a shard; words of a range; texts and keys of each in the sample.
SHARD, RANGE, SAMPLE, KEYS = 1_250_000, 1_250_000, 2048, 64
#: Bytes between words, and bytes between pieces.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Bound = tuple[bytes, bytes, bytes]


class Words:
    """Words of texts, as numbers in the order they come: word, piece and text of each."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.word: list[np.ndarray] = []
        self.piece: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.langs: dict[bytes, int] = {}
        self.pieces = self.n = 0

    def add(self, texts: list[str | None], langs: list[str | None]) -> np.ndarray:
        """Reads whole texts; gives the text of each of their words."""
        raw = [(x or "").encode() for x in texts]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = _KIND[buf]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)
        letters = _LOWER[buf[inside]]
        found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        ids = np.array([self.known.setdefault(w, len(self.known)) for w in found.dictionary.to_pylist()], np.int64)
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), begin, "right")
        of = np.array([self.langs.setdefault(("und" if x is None else x).encode(), len(self.langs)) for x in langs], np.int64)
        self.word.append(ids[found.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64))
        self.piece.append(np.cumsum(kind == 2)[begin] + self.pieces)
        self.lang.append(of[text])
        self.pieces += int((kind == 2).sum())
        self.n += len(begin)
        return text


def _ranked(known: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """The keys in the order of their bytes, and the rank of each number."""
    keys = sorted(known)
    rank = np.empty(len(keys), np.int64)
    rank[[known[k] for k in keys]] = np.arange(len(keys))
    return keys, rank


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and their summed counts. Sorted runs are merged by a sort that finds them."""
    order = key.argsort(kind="quicksort" if n is None else "stable")
    s = key[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.diff(np.append(at, len(s))) if n is None else np.add.reduceat(n[order], at) if len(s) else n
    return s[at], place, total


class Trie:
    """Levels of (parent, word, count), each sorted by parent and word. The first level's parents are languages."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], langs: list[bytes] = []):
        self.words, self.levels, self.langs = words, levels, langs

    @classmethod
    def of(cls, read: Words) -> Trie:
        words, rank = _ranked(read.known)
        langs, lang_rank = _ranked(read.langs)
        word, piece, node = rank[np.concatenate(read.word)], np.concatenate(read.piece), lang_rank[np.concatenate(read.lang)]
        at, v, levels = np.arange(len(word)), max(1, len(words)), []
        for d in range(DEPTH):
            if d:
                fits = at + d < len(word)
                fits[fits] = piece[at[fits]] == piece[at[fits] + d]
                at, node = at[fits], node[fits]
            key, node, n = _counted(node * v + word[at + d])
            levels.append((key // v, key % v, n))
        return cls(words, levels, langs)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """The sum of tries of one language."""
        words = sorted(set().union(*(t.words for t in tries)))
        rank, v = {w: i for i, w in enumerate(words)}, max(1, len(words))
        to = [np.array([rank[w] for w in t.words], np.int64) for t in tries]
        nodes, levels = [np.zeros(1, np.int64)] * len(tries), []
        for d in range(DEPTH):
            key = np.concatenate([nodes[i][t.levels[d][0]] * v + to[i][t.levels[d][1]] for i, t in enumerate(tries)])
            key, place, n = _counted(key, np.concatenate([t.levels[d][2] for t in tries]))
            nodes = np.split(place, np.cumsum([len(t.levels[d][0]) for t in tries])[:-1])
            levels.append((key // v, key % v, n))
        return cls(words, levels)

    def size(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def cut(self, bounds: list[Bound]) -> Iterator[tuple[int, bytes, Trie]]:
        """range, language and that range's part of the trie. bounds: where each range but the first begins."""
        (lang, w1, _), (p2, w2, _) = self.levels[0], self.levels[1]
        v = max(1, len(self.words))
        key1, key2 = lang * v + w1, p2 * v + w2
        below, upto, second = [0], [0], [0]
        for bl, b1, b2 in bounds:
            i, j = bisect_left(self.langs, bl), bisect_left(self.words, b1)
            here = i < len(self.langs) and self.langs[i] == bl
            k = i * v + j if here else i * v
            p = int(np.searchsorted(key1, k))
            same = here and j < len(self.words) and self.words[j] == b1 and p < len(key1) and key1[p] == k
            below.append(p)
            upto.append(p + bool(same))
            second.append(int(np.searchsorted(key2, p * v + (bisect_left(self.words, b2) if same else 0))))
        begins = np.searchsorted(lang, np.arange(len(self.langs) + 1)).tolist()
        upto.append(len(key1))
        second.append(len(key2))
        for q in range(len(bounds) + 1):
            a, z = below[q], upto[q + 1]
            while a < z:
                i = int(lang[a])
                stop = min(z, begins[i + 1])
                yield q, self.langs[i], self._part(a, stop, second[q], second[q + 1])
                a = stop

    def _part(self, a: int, z: int, least: int, most: int) -> Trie:
        levels, lo, hi = [(np.zeros(z - a, np.int64), self.levels[0][1][a:z], self.levels[0][2][a:z])], a, z
        for d in range(1, DEPTH):
            parent, word, n = self.levels[d]
            x, y = (int(i) for i in np.searchsorted(parent, [lo, hi]))
            if d == 1:
                x, y = max(x, least), max(max(x, least), min(y, most))
            levels.append((parent[x:y] - lo, word[x:y], n[x:y]))
            lo, hi = x, y
        used = np.unique(np.concatenate([x[1] for x in levels]))
        return Trie([self.words[i] for i in used.tolist()], [(p, np.searchsorted(used, w), n) for p, w, n in levels])

    def packed(self) -> tuple[bytes, bytes]:
        """Its words, and its levels: sizes, then numbers of children, words and counts."""
        parts = [np.array([len(x[0]) for x in self.levels], np.uint32)]
        for d, (_, w, n) in enumerate(self.levels):
            kids = [np.bincount(self.levels[d + 1][0], minlength=len(w))] if d + 1 < DEPTH else []
            parts += [x.astype(np.uint32) for x in (w, n, *kids)]
        return b" ".join(self.words), pa.Codec("zstd", compression_level=1).compress(np.concatenate(parts), asbytes=True)

    @classmethod
    def unpacked(cls, words: bytes, raw: bytes, size: int) -> Trie:
        x = np.frombuffer(pa.Codec("zstd").decompress(raw, size, asbytes=True), np.uint32).astype(np.int64)
        sizes, at, parent, levels = x[:DEPTH].tolist(), DEPTH, np.zeros(int(x[0]), np.int64), []
        for d, m in enumerate(sizes):
            levels.append((parent, x[at : at + m], x[at + m : at + 2 * m]))
            at += 2 * m
            if d + 1 < DEPTH:
                parent = np.repeat(np.arange(m), x[at : at + m])
                at += m
        return cls(words.split(b" ") if words else [], levels)

    def found(self, lang: bytes, own: set[bytes], least: int) -> pa.RecordBatch:
        """A row for each sequence of `least` occurrences with the counts of its left parts; first the number of all words. own: first words that are counted here."""
        names = pa.array(self.words, pa.binary())
        mine = np.array([self.words[w] in own for w in self.levels[0][1].tolist()], bool)
        out = [(pa.array([""]), self.levels[0][2][mine].sum(keepdims=True), np.zeros((1, 0), np.int64))]
        keep = np.flatnonzero(self.levels[0][2] >= least)
        text, left, here = names.take(pa.array(self.levels[0][1][keep])), np.zeros((len(keep), 0), np.int64), np.flatnonzero(mine[keep])
        out.append((text.take(pa.array(here)).cast(pa.string()), self.levels[0][2][keep][here], left[here]))
        for d in range(1, DEPTH):
            parent, word, n = self.levels[d]
            row = np.full(len(self.levels[d - 1][0]), -1)
            row[keep] = np.arange(len(keep))
            above = self.levels[d - 1][2]
            keep = np.flatnonzero(n >= least)
            up = row[parent[keep]]
            left = np.column_stack([left[up], above[parent[keep]]])
            text = pc.binary_join_element_wise(text.take(pa.array(up)), names.take(pa.array(word[keep])), pa.scalar(b" "))
            out.append((text.cast(pa.string()), n[keep], left))
        depth = np.repeat(np.arange(DEPTH + 1), [len(x[1]) for x in out])
        lefts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.maximum(depth - 1, 0))]), pa.int32()), pa.array(np.concatenate([x[2].ravel() for x in out]), pa.int64()))
        langs = pa.array([lang.decode()] * len(depth), pa.string())
        phrase = pa.concat_arrays([x[0] for x in out])
        return pa.RecordBatch.from_arrays([langs, pa.array(depth, pa.int32()), phrase, pa.array(np.concatenate([x[1] for x in out]), pa.int64()), lefts], names=["lang", "depth", "phrase", "a", "lefts"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str | None], list[str | None]]]:
    for big in batches:
        for lo in range(0, big.num_rows, 128):
            b = big.slice(lo, 128)
            yield b.column("text").to_pylist(), b.column("lang").to_pylist()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two words behind each other at even distances in each text, with the words that each stands for."""
    for texts, langs in _slices(batches):
        read = Words()
        text = read.add(texts, langs)
        names, tongues, word, piece, lang = list(read.known), list(read.langs), read.word[0], read.piece[0], read.lang[0]
        out = []
        for lo, hi in zip(np.searchsorted(text, np.arange(len(texts))).tolist(), np.searchsorted(text, np.arange(len(texts)), "right").tolist()):
            two = lo + np.flatnonzero(piece[lo : hi - 1] == piece[lo + 1 : hi]) if hi - lo > 1 else np.zeros(0, np.int64)
            picked = two[np.linspace(0, len(two) - 1, min(KEYS, -(-len(two) // 8))).astype(np.int64)] if len(two) else two
            out += [(tongues[lang[i]], names[word[i]], names[word[i + 1]], (hi - lo) / len(picked)) for i in picked.tolist()]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.float64())], names=["lang", "w1", "w2", "words"])


def bounds_of(docs: DataFrame) -> list[Bound]:
    """Where the ranges but the first begin: each has about RANGE words, and there are as many as shuffle partitions at least."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    rows = (docs.sample(share, seed=11) if share < 1 else docs).mapInArrow(_sampled, "lang binary, w1 binary, w2 binary, words double").collect()
    keys = sorted((bytes(r.lang), bytes(r.w1), bytes(r.w2), r.words) for r in rows)
    upto = np.cumsum([k[3] for k in keys]) if keys else np.zeros(1)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(np.ceil(upto[-1] / share / RANGE)))
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return sorted({keys[i][:3] for i in at.tolist() if i < len(keys)})


def counted(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, depth, phrase, a and lefts (counts of its first words, but the whole) of all sequences of `least` occurrences; depth 0: all words, one row a range."""
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    bounds = bounds_of(docs)
    ends = [(b[0], b[1]) for b in bounds]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(read: Words) -> Iterator[pa.RecordBatch]:
            for q, tongue, part in Trie.of(read).cut(bounds):
                words, raw = part.packed()
                size = 4 * (DEPTH + sum(len(x[0]) * (3 if d + 1 < DEPTH else 2) for d, x in enumerate(part.levels)))
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([tongue], pa.binary()), pa.array([words], pa.binary()), pa.array([raw], pa.binary()), pa.array([size], pa.int64())], names=["range", "lang", "words", "trie", "size"])

        read = Words()
        for texts, langs in _slices(batches):
            read.add(texts, langs)
            if read.n >= SHARD:
                yield from out(read)
                read = Words()
        if read.n:
            yield from out(read)

    def merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at: tuple[int, bytes], held: list[Trie]) -> pa.RecordBatch:
            # The count of a first word is in every range that holds some of its sequences; its own range is the one where the word alone would stand.
            q, tongue = at
            t = Trie.merged(held)
            before = bounds[q - 1] if q else None
            own = {w for w in t.words if before is None or ends[q - 1] < (tongue, w)}
            return t.found(tongue, own, least)

        at, held, size = None, [], 0
        for b in batches:
            for q, tongue, words, raw, n in zip(*(b.column(c).to_pylist() for c in ("range", "lang", "words", "trie", "size"))):
                if at != (q, tongue):
                    if at:
                        yield done(at, held)
                    at, held, size = (q, tongue), [], 0
                held.append(Trie.unpacked(words, raw, n))
                size += held[-1].size()
                if size > 2 * SHARD and len(held) > 1:
                    held = [Trie.merged(held)]
                    size = min(held[0].size(), SHARD)
        if at:
            yield done(at, held)

    tries = docs.mapInArrow(shards, "range int, lang binary, words binary, trie binary, size long")
    dealt = tries.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(merges, "lang string, depth int, phrase string, a long, lefts array<bigint>")


def phrases(docs: DataFrame, *, least: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases, by score, count and phrase."""
    scratch = scratch or Scratch(docs.sparkSession)
    every = scratch.keep(counted(docs, least, text, lang), "counted")
    n = every.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    found = every.where("depth > 1")
    cuts = found.select("lang", "phrase", "depth", "a", F.posexplode("lefts").alias("k", "l"))
    cuts = cuts.withColumns({"k": F.col("k") + 1, "rest": F.expr("substring_index(phrase, ' ', k + 1 - depth)")})
    rights = every.where("depth > 0").select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)").alias("score")
    lowest = cuts.join(rights, ["lang", "rest"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    words, parts = F.split("phrase", " "), []
    for d in range(3, DEPTH + 1):
        for m in range(2, d):
            parts += [F.when(F.col("depth") == d, F.array_join(F.slice(words, i + 1, m), " ")) for i in range(d - m + 1)]
    inside = every.where("depth > 2").select("lang", F.explode(F.array(*parts)).alias("phrase"), "a").where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    over = F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(20,0)) >= CAST({covered} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0))")
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(~over, F.lit(True))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked, _ = placed(scratch.keep(left, "scored"), "lang", [F.desc("score"), F.desc("a"), "phrase"], scratch, "ranked")
    return ranked.where(F.col("place") < top).join(n, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
