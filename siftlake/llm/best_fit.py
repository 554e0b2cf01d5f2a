"""Packing documents into few sequences by bounded-space online best fit.

A document longer than a sequence is cut into pieces of a whole sequence each; what is left of it, and every shorter document, is an item. Items meet
the open bins one by one, the largest first: an item goes to the bin with the least free space that holds it, else to a new bin. At most OPEN
bins are open; beyond that the fullest closes. The free spaces that occur among the open bins are the bits of one integer, so that the best bin is a shift
and a lowest bit away.

Plan: one pass tokenises and writes the documents; only the items' numbers and sizes are then shuffled, dealt by hash to tasks of some thousand items (fewer than OPEN bins hold, so that
small items still find the large ones' bins). Bins that are left with more than a SLACK-th of a sequence free at the end of a task give their items to a further round on an eighth of the tasks,
until a single task is left; it meets at most OPEN bins of each of the tasks before. So no task holds more than a fixed number of items however large the table is, and only the last one ends with bins that nothing may fill. The
rounds are written, so that a task that runs again finds the same bins. Pieces are cut in the row and meet their bins by an equi-join.

Defined cases: null text is empty; an empty text is one piece that holds the end id only (none without end id); null ids and repeated rows are packed like
others; a text of exactly a sequence's length fills one; very long texts are cut; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch
from siftlake.llm.packing import vocabulary_size, word_cache

#: Bins that are open at once; items of a task; how much fewer tasks each round has; a bin with less than this part free is full.
OPEN, ITEMS, FEWER, SLACK = 8192, 1 << 14, 8, 64


class Bins:
    """Open bins by free space. A bin is its list of (item, size) so far; `close` is handed each one that takes no more."""

    def __init__(self, length: int, most: int, close: Callable[[list[tuple[int, int]]], None]):
        self.length, self.most, self.close = length, most, close
        self.free: dict[int, list[list[tuple[int, int]]]] = defaultdict(list)
        self.bits, self.n = 0, 0

    def take(self, free: int) -> list[tuple[int, int]]:
        bins = self.free[free]
        out = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n -= 1
        return out

    def fullest(self, least: int = 0) -> int:
        """The smallest free space of at least so many tokens, or -1."""
        fit = self.bits >> least
        return (fit & -fit).bit_length() - 1 + least if fit else -1

    def add(self, item: int, size: int) -> None:
        free = self.fullest(size)
        held = self.take(free) if free >= 0 else []
        held.append((item, size))
        left = (free if free >= 0 else self.length) - size
        if not left:
            self.close(held)
            return
        if self.n == self.most:
            self.close(self.take(self.fullest()))
        self.free[left].append(held)
        self.bits |= 1 << left
        self.n += 1

    def rest(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Free space and items of the bins that are still open, the fullest first."""
        while self.n:
            free = self.fullest()
            yield free, self.take(free)


def fitted(length: int, last: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of a round: item, size, bin and place of every item. A bin has the number of its first item; null: the item goes to the next round."""

    def rows(done: list[list[tuple[int, int]]], named: bool) -> pa.RecordBatch:
        item = np.array([i for b in done for i, _ in b], np.int64)
        size = np.array([s for b in done for _, s in b], np.int64)
        n = [len(b) for b in done]
        begin = np.cumsum(size) - size
        place = begin - np.repeat(begin[np.cumsum(n) - n], n) if len(size) else begin
        first = np.repeat(np.array([b[0][0] for b in done], np.int64), n)
        none = np.full(len(size), not named)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(size), pa.array(first, mask=none), pa.array(place, mask=none)], names=["item", "size", "bin", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list[tuple[int, int]]] = []
        bins = Bins(length, most, done.append)
        for b in batches:
            for item, size in zip(b.column("item").to_pylist(), b.column("size").to_pylist()):
                bins.add(item, size)
            yield rows(done, True)
            done.clear()
        rest = list(bins.rest())
        yield rows([b for free, b in rest if last or free * SLACK <= length], True)
        yield rows([b for free, b in rest if not last and free * SLACK > length], False)

    return run


def tokenised(docs: DataFrame, tokenizer: str, length: int, end_id: int | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, first (the number of its first piece, counted through all documents), n_tokens and ids (little-endian bytes of the tokenizer's width) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at = word_cache(tokenizer), TaskContext.get().partitionId() << 33
        end = b"" if end_id is None else np.array([end_id], cache.dtype).tobytes()
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                ids = [x + end for x in cache.ids(b.column(text).to_pylist())]
                n = np.array([len(x) // cache.dtype.itemsize for x in ids], np.int64)
                pieces = (n + length - 1) // length
                first = at + np.cumsum(pieces) - pieces
                at += int(pieces.sum())
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(first), pa.array(n), pa.array(ids, pa.binary())], names=[id_col, "first", "n_tokens", "ids"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, first long, n_tokens long, ids binary")


def binned(items: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """item, bin and place of items (item, size; sizes from 1 to length - 1; items are told apart by their number)."""
    tasks, nth, done = max(1, -(-items.count() // ITEMS)), 0, []
    while True:
        dealt = items.repartition(tasks, "item").sortWithinPartitions(F.desc("size"), F.xxhash64("item"), "item")
        fit = scratch.keep(dealt.mapInArrow(fitted(length, tasks == 1, OPEN), "item long, size long, bin long, place long"), f"round_{nth}")
        done.append(fit.where("bin IS NOT NULL").select("item", "bin", "place"))
        if tasks == 1:
            break
        items, tasks, nth = fit.where("bin IS NULL").select("item", "size"), -(-tasks // FEWER), nth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out


def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's 16-bit numbers as 32-bit ones: half as much is written and shuffled before."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(b.num_columns - 1)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        raw = np.frombuffer(data, "<u2", count=int(at[-1] - at[0]) // 2, offset=int(at[0])).astype("<u4")
        wide = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((at - at[0]) * 2), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], wide.cast(pa.binary())], names=b.schema.names)


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int | None = 0, text: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The pieces: id, piece, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit numbers). A sequence's pieces lie in it from offset 0 without gaps."""
    scratch, wide = scratch or Scratch(docs.sparkSession), 2 if vocabulary_size(tokenizer) <= 1 << 16 else 4
    toks = scratch.keep(tokenised(docs, tokenizer, length, end_id, text, id_col), "tokens", "snappy").where("n_tokens > 0")
    # The last piece's place among its document's, its number among all, and its size.
    whole = F.expr(f"(n_tokens - 1) div {length}")
    toks = toks.withColumns({"whole": whole, "item": F.col("first") + whole, "size": F.col("n_tokens") - whole * length})
    bins = binned(toks.where(f"size < {length}").select("item", "size"), length, scratch)
    met = toks.join(bins, "item", "left").select(id_col, "first", "n_tokens", "ids", "bin", "place", "whole", F.explode(F.sequence(F.lit(0).cast("long"), "whole")).alias("piece"))
    start = F.col("piece") * length
    size = F.least(F.lit(length).cast("long"), F.col("n_tokens") - start)
    own = (F.col("piece") < F.col("whole")) | F.col("bin").isNull()
    out = met.select(
        id_col, F.col("piece").cast("int").alias("piece"), start.alias("start"), size.alias("length"),
        F.when(own, F.col("first") + F.col("piece")).otherwise(F.col("bin")).alias("sequence_id"), F.when(own, F.lit(0).cast("long")).otherwise(F.col("place")).alias("offset"),
        F.substring("ids", (start * wide + 1).cast("int"), (size * wide).cast("int")).alias("ids"),
    )
    return out if wide == 4 else out.mapInArrow(widened, out.schema)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, filled up with pad_id. A sequence has at most `length` pieces."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    pad = np.array([pad_id], "<u4").tobytes().hex().upper()
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.rpad(F.array_join(parts, ""), length * 8, pad)).alias("ids"))


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
