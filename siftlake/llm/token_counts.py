"""Token counts by count-only Viterbi over a unigram vocabulary.

The lattice keeps every node's best score and the number of pieces on the way to it, no back pointers: nothing but the
count is wanted. Equal scores go to the piece that starts first, as in the library's unigram encoder; characters that are no piece cost the
least score less 10 and count as their UTF-8 bytes. Scores are summed in 64-bit floats.

Each worker keeps the counts of the cuts it has met (at most CACHED; then it starts anew).

Defined cases: null and empty texts have 0 tokens and score 0; null ids and repeated rows are counted each; an empty table gives
an empty result; other columns are not read. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.lattice import Vocabulary, build, unknown_lengths, viterbi, vocabulary

CACHED, CHARS = 800_000, 1_000_000


class Counter:
    """Pieces and score of cuts, held as one complex number (count + score * i), so that one sum adds both."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: dict[str, complex] = {}

    def learn(self, new: list[str]) -> None:
        lo = 0
        while lo < len(new):
            hi, chars = lo, 0
            while hi < len(new) and (hi == lo or chars < CHARS):
                chars += len(new[hi])
                hi += 1
            part = new[lo:hi]
            lat = build(self.v, part)
            score, n = viterbi(lat, unknown_lengths(lat, part))
            self.known.update(zip(part, (n + 1j * score).tolist()))
            lo = hi

    def count(self, texts: list[str | None]) -> list[complex]:
        cuts = [self.v.chunks(x or "") for x in texts]
        every = set().union(*cuts)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(every)
        self.learn(new)
        return [sum(map(self.known.__getitem__, c), 0j) for c in cuts]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, score for every row. model: path of a SentencePiece model file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(model, Counter(vocabulary(model)))
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                got = counter.count(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([int(x.real) for x in got], pa.int64()), pa.array([x.imag for x in got], pa.float64())], names=[id_col, "n_tokens", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, n_tokens long, score double")
