"""Languages of texts by their runs of characters.

A text's bytes (lower-cased A-Z, white space as one space, a space before and behind) are read in runs of two to four, which are hashed to BUCKETS; a language's profile is the smoothed logarithm
of how often each bucket occurs in its texts, against all languages together. A text has the language whose profile sums highest over its runs, and how sure that is: the mean
difference to the next. Profiles are fitted on a bounded sample; texts are scored whole, a batch at a time.

Null and empty texts have no language; of equal sums the first name wins; a single language is always found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that profiles are fitted on, at most twice so many; hashed runs; lengths of runs; a run's count before any was seen.
SAMPLE, BUCKETS, RUNS, SMOOTH = 4000, 1 << 14, (2, 3, 4), 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def runs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed runs of all texts, and the text that each is of."""
    raw = [b" " + x.encode() + b" " if x else b"" for x in texts]
    flat = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    text = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    again = np.zeros(len(flat), bool)
    again[1:] = (flat[1:] == 32) & (flat[:-1] == 32) & (text[1:] == text[:-1])
    flat, text = flat[~again].astype(np.uint32), text[~again]
    out, of = [], []
    for n in RUNS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, 2166136261 * n % (1 << 32), np.uint32)
        for i in range(n):
            h = (h ^ flat[i : len(flat) - n + 1 + i]) * np.uint32(16777619)
        same = text[: len(flat) - n + 1] == text[n - 1 :]
        out.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))[same])
        of.append(text[: len(flat) - n + 1][same])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclass
class Profiles:
    langs: list[str]
    weights: np.ndarray  #: buckets x languages

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of each text's runs by language, and how many runs it has."""
        run, text = runs_of(texts)
        n = np.bincount(text, minlength=len(texts))
        if not self.langs:
            return np.zeros((len(texts), 0)), n
        total = np.stack([np.bincount(text, self.weights[run, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        return total / np.maximum(n, 1)[:, None], n


def _batches(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)


def fitted(docs: DataFrame, key: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages that the table names. The sample is chosen by the keys' hash; each task sends its counts, not its texts."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in _batches(batches):
            names = b.column("lang").to_pylist()
            run, at = runs_of(b.column("text").to_pylist())
            for name in set(names):
                own = np.array([x == name for x in names])[at]
                total[name] = total.get(name, 0) + np.bincount(run[own], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in drawn.select("lang", "text").mapInArrow(counted, "lang string, counts binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(bytes(r.counts), np.int64)
    langs = sorted(total)
    n = np.stack([total[k] for k in langs], axis=1).astype(float) + SMOOTH if langs else np.zeros((BUCKETS, 0))
    part = n / n.sum(0)
    return Profiles(langs, np.log(part) - np.log(part.mean(1, keepdims=True)) if langs else n)


def detected(docs: DataFrame, profiles: Profiles, text: str = "text", default: str | None = None) -> DataFrame:
    """docs with `language` (default: where there is nothing to go by) and `margin`, the mean difference to the next language."""
    schema = docs.select("*", F.lit("").alias("language"), F.lit(0.0).alias("margin")).schema
    schema["language"].nullable = schema["margin"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            mean, n = profiles.scores(b.column(text).to_pylist())
            top = np.argmax(mean, axis=1) if profiles.langs else np.zeros(len(n), int)
            rest = np.sort(mean, axis=1)
            gap = rest[:, -1] - rest[:, -2] if len(profiles.langs) > 1 else np.zeros(len(n))
            names = [profiles.langs[k] if m and profiles.langs else default for k, m in zip(top.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.where(n > 0, gap, np.nan), pa.float64(), mask=n == 0)], names=[*b.schema.names, "language", "margin"])

    return docs.mapInArrow(run, schema)


def saved(profiles: Profiles, spark, path: str) -> None:
    rows = [(k, profiles.weights[:, i].tolist()) for i, k in enumerate(profiles.langs)]
    spark.createDataFrame(rows, "lang string, weights array<double>").write.mode("overwrite").parquet(path)


def opened(spark, path: str) -> Profiles:
    rows = sorted(spark.read.schema("lang string, weights array<double>").parquet(path).collect())
    return Profiles([r.lang for r in rows], np.array([r.weights for r in rows]).T if rows else np.zeros((BUCKETS, 0)))
