"""The best chunks of each of many questions, without an index of all words.

One pass over the texts cuts them into chunks and counts the questions' lexemes in each: only these counts are written, and no word is shuffled. A pass over the counts
gives the document frequencies, and one more scores every chunk for every question, of which a task keeps k chunks each. Chunks, lexemes and scores are those
of `chunking.uniform_chunks`, `text.usimple` and `keyword_index`.

All questions' lexemes go to every task: for more than MOST of them, there is the index.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import pywords
from siftlake.operators import keyword
from siftlake.operators.chunking import OVERLAP, SIZE

#: (question, lexeme) pairs that go to every task; chunks in a written batch; products at once.
MOST, ROWS, BLOCK = 200_000, 2048, 1 << 20


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """chunk_num, page and text of the chunks of a text whose pages are its lines."""
    pages = text.split("\n")
    whole, ends, step = "".join(pages), list(accumulate(map(len, pages))), size - overlap
    for i, start in enumerate(range(0, len(whole), step)):
        yield i + 1, bisect_right(ends, start) + 1, whole[start : start + size]


def counter(lexemes: list[str], letters: pywords.Letters) -> Callable[[str, str, str], Iterator[tuple[int, dict[int, int], dict[int, int]]]]:
    """A function of a document's text, name and summary: the number of each chunk, and how often it holds which lexemes (by place) in the classes A and B; each is in A, if only with 0."""
    place = {x: i for i, w in enumerate(lexemes) for x in pywords.spellings(w)}
    analyzer, get = letters.analyzer(), place.get

    def held(words: list) -> dict[int, int]:
        found = Counter(map(get, words))
        found.pop(None, None)
        return found

    def count(text: str, name: str, summary: str) -> Iterator[tuple[int, dict[int, int], dict[int, int]]]:
        words = analyzer(text)
        b, own = held(words(summary)), held([*letters.words(name), "page"])
        for number, page, chunk in cut(text):
            a = held(words(chunk))
            for i, n in own.items():
                a[i] += n
            if (i := get(str(page))) is not None:
                a[i] += 1
            for i in b:
                a.setdefault(i, 0)
            yield number, a, b

    return count


def write_hits(docs: DataFrame, lexemes: list[str], path: str) -> None:
    """A row for each chunk, also of those that hold none. docs: doc_id, text, name and summary."""
    letters = pywords.letters(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(lexemes, letters)
        ids, numbers, size, lex, n_a, n_b = [], [], [], [], [], []

        def batch() -> pa.RecordBatch:
            order = np.lexsort((lex, np.repeat(np.arange(len(size)), size)))
            at = pa.array(np.cumsum([0, *size]), pa.int32())
            each = [pa.ListArray.from_arrays(at, pa.array(np.array(x, np.int32)[order])) for x in (lex, n_a, n_b)]
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), *each], names=["doc_id", "chunk_num", "lexemes", "n_a", "n_b"])
            for x in (ids, numbers, size, lex, n_a, n_b):
                x.clear()
            return out

        for b in batches:
            for doc, text, name, summary in zip(*(b.column(c) for c in ("doc_id", "text", "name", "summary")), strict=True):
                if not text.is_valid:
                    continue
                for number, in_a, in_b in count(text.as_py(), name.as_py() or "", summary.as_py()):
                    ids.append(doc.as_py())
                    numbers.append(number)
                    size.append(len(in_a))
                    lex.extend(in_a)
                    n_a.extend(in_a.values())
                    n_b.extend([in_b.get(i, 0) for i in in_a])
                    if len(ids) >= ROWS:
                        yield batch()
        if ids:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "name", "summary")
    rows.mapInArrow(run, "doc_id long, chunk_num int, lexemes array<int>, n_a array<int>, n_b array<int>").write.mode("overwrite").parquet(path)


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of a column's lists, and what they hold."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


@dataclass
class ManyHits:
    """What `write_hits` wrote. lexemes: in the order in which they were given."""

    spark: SparkSession
    path: str
    lexemes: list[str]

    @cached_property
    def chunks(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, chunk_num int, lexemes array<int>, n_a array<int>, n_b array<int>").parquet(self.path)

    @cached_property
    def idf(self) -> np.ndarray:
        """Of each lexeme; from the number of chunks and of those that hold it."""
        width = len(self.lexemes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n = np.zeros(width, np.int64), 0
            for b in batches:
                df += np.bincount(lists(b.column(0))[1], minlength=width)
                n += b.num_rows
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n, *df[some]], pa.int64())], names=["place", "n"])

        found = {r.place: r.n for r in self.chunks.select("lexemes").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        df = np.array([found.get(i, 0) for i in range(width)], np.float64)
        return np.log(1 + (found.get(-1, 0) - df + 0.5) / (df + 0.5))

    def top(self, terms: pa.Table, k: int, kind: str) -> DataFrame:
        """item, doc_id, chunk_id, s (to nine places) and rank of the k best chunks of each question that has some. terms: item and lexeme, each pair once; kind: the items' type; chunk_id = doc_id * 10000 + chunk_num."""
        item, place = terms.column_names[0], {w: i for i, w in enumerate(self.lexemes)}
        coded = terms.column(0).combine_chunks().dictionary_encode()
        items, lex = coded.dictionary, np.array([place[w] for w in terms.column(1).to_pylist()], np.int64)
        asked, by = coded.indices.to_numpy()[np.argsort(lex, kind="stable")].astype(np.int64), np.bincount(lex, minlength=len(place))
        begin, idf, n_items = np.cumsum(by) - by, self.idf, len(items)

        def scores(row: np.ndarray, lex: np.ndarray, part: np.ndarray, n_rows: int) -> np.ndarray:
            """Of all pairs of a block's chunks and questions: a chunk's parts are summed in the order of the lexemes."""
            n = by[lex]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[lex] - (ends - n), n)
            return np.bincount(np.repeat(row * n_items, n) + asked[at], np.repeat(part, n), n_rows * n_items)

        def best(cols: list[np.ndarray]) -> list[np.ndarray]:
            j, doc, chunk, s = cols
            order = np.lexsort((chunk, -s, j))
            j = j[order]
            first = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, np.int64)
            nth = np.arange(len(j)) - np.repeat(first, np.diff(np.r_[first, len(j)]))
            return [c[order][nth < k] for c in (cols[0], doc, chunk, s)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, floor = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.zeros(n_items)
            for b in batches:
                doc, number = b.column("doc_id").to_numpy(), b.column("chunk_num").to_numpy()
                size, lex = lists(b.column("lexemes"))
                n_a, n_b = lists(b.column("n_a"))[1], lists(b.column("n_b"))[1]
                damped = np.cumsum(np.r_[0.0, 1 / np.arange(1, (n_a + n_b).max(initial=0) + 1, dtype=np.float64) ** 2])
                tf = (keyword.WEIGHTS["A"] * damped[n_a] + keyword.WEIGHTS["B"] * (damped[n_a + n_b] - damped[n_a])) / keyword.BASEL
                part, ends = tf / (tf + 1) * idf[lex], np.cumsum(size)
                row = np.repeat(np.arange(len(size)), size)
                # A block has as many products or results as fit, and one chunk at least.
                work = np.cumsum(np.maximum(np.bincount(row, by[lex], len(size)), n_items))
                lo = 0
                while lo < len(size):
                    hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + BLOCK, "right")))
                    x, y = ends[lo] - size[lo], ends[hi - 1]
                    s = scores(row[x:y] - lo, lex[x:y], part[x:y], hi - lo).reshape(hi - lo, n_items)
                    s = np.floor(s * 1e9 + 0.5) / 1e9
                    r, j = np.nonzero((s > 0) & (s >= floor))
                    kept = best([np.r_[old, new] for old, new in zip(kept, (j, doc[lo + r], doc[lo + r] * 10000 + number[lo + r], s[r, j]), strict=True)])
                    full = np.bincount(kept[0], minlength=n_items) >= k
                    floor[full] = kept[3][np.searchsorted(kept[0], np.flatnonzero(full), "right") - 1]
                    lo = hi
            j, *rest = kept
            if len(j):
                yield pa.RecordBatch.from_arrays([items.take(pa.array(j)), *map(pa.array, rest)], names=[item, "doc_id", "chunk_id", "s"])

        w = Window.partitionBy(item).orderBy(F.desc("s"), "chunk_id")
        found = self.chunks.mapInArrow(run, f"{item} {kind}, doc_id long, chunk_id long, s double")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
