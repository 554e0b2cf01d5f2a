"""Packing documents into sequences along a space-filling curve.

A document's token ids are counted in hashed dimensions, scaled, and projected by fixed random signs to few
dimensions; the point's place on a Hilbert curve is the document's key. Documents are range-sorted by that key, so
neighbours in a sequence are alike, and the run of all their ids is cut every `length` ids: only the last
sequence of the whole corpus is padded.

Plan: one pass tokenises and writes (document, key, number of ids, ids) to scratch. A narrow range shuffle of the
keys, with the id behind the key so that equal documents spread over many tasks, gives every document its place in
the run: running sums in each range, plus the ranges' totals (one number a task on the driver). The places
are joined to the written ids by a row number and each document is cut where the sequences end.

Defined cases: null text is empty; an empty text is one piece that holds the end id only; null ids sort first and are
packed like others; repeated rows are packed each; an empty table gives no pieces; very long texts span many
sequences; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch

HASHED, DIMS, BITS = 256, 4, 12
CACHED_WORDS = 500_000


#: A mark that ends a word, and words that are one run of letters with or without one run of marks.
END_MARK = re.compile(rb"[,.](?<=[a-z0-9][,.])(?=[ \n]|\Z)")
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*]*)").fullmatch


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class WordCache:
    """Ids of texts, by words: exact for the lower-casing byte-level tokenizer that drops white space and never joins across it.

    Texts are lower-cased (A-Z), split at ASCII white space and before a comma or full stop that ends a word, where the
    tokenizer splits too; each word is encoded once while it is cached. Plain words go straight to the tokenizer's merges, as nothing
    else happens to them; others go through all of it. Ids are kept as little-endian bytes,
    2 each if the vocabulary allows. Texts that spell a special token are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Runs of letters or of marks, lower-cased, by the merges alone."""
        runs = "\0".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        ids, size = [], []
        for run in map(self.merges.tokenize, runs):
            ids += [t.id for t in run]
            size.append(len(run) * self.dtype.itemsize)
        raw, stop = np.array(ids, self.dtype).tobytes(), np.cumsum(size).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]

    def learn(self, words: list[bytes]) -> None:
        plain, runs, marks, other = [], [], [], []
        for w, s in zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n")):
            if m := PLAIN(s):
                plain.append(w)
                runs.append(m[1].lower())
                marks.append(m[2])
            else:
                other.append((w, s))
        if plain:
            kinds = list(set(marks) - {""})
            tail = {"": b"", **dict(zip(kinds, self.encode_plain(kinds) if kinds else []))}
            for lo in range(0, len(plain), 4096):
                for w, x, m in zip(plain[lo : lo + 4096], self.encode_plain(runs[lo : lo + 4096]), marks[lo : lo + 4096]):
                    self.known[w] = x + tail[m] if m else x
        if other:
            self.known.update(zip([w for w, _ in other], self.encode([s for _, s in other])))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        raw = [(x or "").encode("utf-8", "replace") for x in texts]
        split = [None if b"<|" in x else END_MARK.sub(rb" \g<0>", x.lower()).split() for x in raw]
        new = list(set().union(*(ws or () for ws in split)).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(set().union(*(ws or () for ws in split)))
        self.learn(new)
        return [self.encode([x or ""])[0] if ws is None else b"".join(map(self.known.__getitem__, ws)) for x, ws in zip(texts, split)]


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(20).choice([-1.0, 1.0], size=(HASHED, DIMS))


def points(ids: list[np.ndarray]) -> np.ndarray:
    """Projections of the hashed, log-scaled, unit-length id counts."""
    out = np.zeros((len(ids), HASHED))
    for lo in range(0, len(ids), 256):
        part = ids[lo : lo + 256]
        row = np.repeat(np.arange(len(part), dtype=np.uint32) * np.uint32(HASHED), [len(x) for x in part])
        slot = (np.concatenate(part).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        out[lo : lo + 256] = np.log1p(np.bincount(row + slot, minlength=len(part) * HASHED)).reshape(-1, HASHED)
    # Sums over rows one by one, so that a document's point does not depend on its batch.
    length = np.sqrt((out * out).sum(axis=1))
    return np.stack([(out * s).sum(axis=1) for s in _signs().T], axis=1) / np.maximum(length, 1e-12)[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of non-negative integers below 2**bits (the transpose form, then interleaved)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_key(ids: list[np.ndarray]) -> np.ndarray:
    """Coordinates of projected unit vectors lie within a few units of 0; the cells cover -4 to 4."""
    p = points(ids)
    return hilbert(np.clip(((p + 4) / 8 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, key, n_tokens and ids (little-endian bytes of the tokenizer's width) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        end = b"" if end_id is None else np.array([end_id], cache.dtype).tobytes()
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                raw = [x + end for x in cache.ids(b.column(text).to_pylist())]
                ids = [np.frombuffer(x, cache.dtype) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(curve_key(ids), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())], names=[id_col, "curve", "n_tokens", "ids"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, curve long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int | None = 1, text: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The pieces: id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit numbers).

    sequence_id counts from 0 along the curve; the pieces of a sequence fill it from offset 0 without gaps.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # A row number that holds in every later job, as it is written.
    toks = scratch.keep(tokenised(docs, tokenizer, end_id, text, id_col).withColumn("row", F.monotonically_increasing_id()), "tokens", "snappy")
    places = _places(toks.select("row", id_col, "curve", "n_tokens"), id_col, scratch)
    wide = np.dtype("<u2" if vocabulary_size(tokenizer) <= 1 << 16 else "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                b = big.slice(lo, 64)
                n = np.array(b.column("n_tokens").to_pylist(), np.int64)
                at = np.array(b.column("place").to_pylist(), np.int64)
                pieces = (at + n - 1) // length - at // length + 1
                which = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                seq = at[which] // length + nth
                begin = np.maximum(seq * length, at[which])
                stop = np.minimum((seq + 1) * length, at[which] + n[which])
                start = begin - at[which]
                raw = b.column("ids")
                parts = [raw[i].as_py() for i in range(b.num_rows)]
                ids = [np.frombuffer(parts[i], wide)[x:y].astype("<u4").tobytes() for i, x, y in zip(which.tolist(), start.tolist(), (stop - at[which]).tolist())]
                cols = [b.column(id_col).take(pa.array(which)), *(pa.array(x.astype(np.int64)) for x in (start, stop - begin, n[which], seq, begin - seq * length)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = toks.select("row", id_col, "n_tokens", "ids").join(places.hint("merge"), "row").where("n_tokens > 0")
    return placed.select(id_col, "n_tokens", "place", "ids").mapInArrow(cut, f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _places(keys: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """row, place: how many ids stand before the document along the curve."""
    spark = keys.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), pa.array(total + np.cumsum(n) - n), b.column("n_tokens")], names=["part", "row", "within", "n_tokens"])
            total += int(n.sum())

    ordered = keys.repartitionByRange(tasks, "curve", id_col, "row").sortWithinPartitions("curve", id_col, "row")
    ranged = scratch.keep(ordered.select(F.spark_partition_id().alias("part"), "row", "n_tokens").mapInArrow(sums, "part int, row long, within long, n_tokens long"), "places")
    base, total = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base.append((part, total))
        total += n
    # One row a task: as many as the session's shuffle partitions.
    before = spark.createDataFrame(base, "part int, before long")
    return ranged.join(F.broadcast(before), "part").select("row", (F.col("within") + F.col("before")).alias("place"))


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ids_crc32 in place of their ids. No Python: a second function would keep a second set of workers with their caches."""
    return pieces.select(id_col, "start", "length", "doc_tokens", "sequence_id", "offset", F.crc32("ids").alias("ids_crc32"))
