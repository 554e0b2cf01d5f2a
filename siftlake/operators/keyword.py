"""Keyword search: postings, BM25-like scores, proximity, blends and highlights."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T

#: Weights of the field classes, and the sum of 1/j^2.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
BASEL = 1.64493406685


#: Rows whose lexemes are counted at once.
ROWS = 256


def postings(df: DataFrame, key: str, fields: dict[str, Column], unique: bool = False) -> DataFrame:
    """key, lexeme, n_a, n_b, n: occurrences by class. fields: class ("A", "B", ...) to an array of lexemes.

    unique: no two rows have the same key. Then a row's lexemes are counted where it is, and nothing is shuffled; else one explode and one partial aggregate.
    """
    if unique:
        return counted_rows(df, key, fields)

    def tagged(c: str, lexemes: Column) -> Column:
        return F.transform(lexemes, lambda w: F.struct(w.alias("lexeme"), F.lit(c).alias("class")))

    every = F.concat(*[tagged(c, v) for c, v in fields.items()])
    rows = df.select(key, F.explode(every).alias("x")).select(key, "x.lexeme", "x.class")
    counts = [F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c.lower()}") for c in ("A", "B")]
    return rows.groupBy(key, "lexeme").agg(*counts, F.count("*").alias("n"))


def counted_rows(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """What `postings` gives, of rows whose keys are unique. A row with a null field has none."""
    classes = list(fields)
    lists = df.select(key, *[v.alias(f"_{c}") for c, v in fields.items()]).dropna(subset=[f"_{c}" for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                b = big.slice(lo, ROWS)
                held = [b.column(f"_{c}") for c in classes]
                size = [np.diff(x.offsets.to_numpy()) for x in held]
                row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in size])
                kind = np.repeat(np.arange(len(held)), [n.sum() for n in size])
                words = pa.concat_arrays([x.flatten() for x in held]).dictionary_encode()
                if not len(words):
                    continue
                width = len(words.dictionary)
                pair, at, n = np.unique(row * width + words.indices.to_numpy(), return_inverse=True, return_counts=True)
                by = {c: np.bincount(at[kind == i], minlength=len(pair)) for i, c in enumerate(classes)}
                none = np.zeros(len(pair), np.int64)
                cols = [b.column(key).take(pa.array(pair // width)), words.dictionary.take(pa.array(pair % width)), *[pa.array(by.get(c, none).astype(np.int64)) for c in ("A", "B")], pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "lexeme", "n_a", "n_b", "n"])

    return lists.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, lexeme string, n_a long, n_b long, n long")


def ts_rank(n: Column) -> Column:
    """Damped frequency of one lexeme whose n occurrences all weigh 1."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j).cast("double")) / BASEL


def ts_rank_weighted(weights: Column) -> Column:
    """Damped frequency of one lexeme; weights: its occurrences' weights in the order of their positions."""
    top = F.array_max(weights)
    at = F.array_position(weights, top).cast("double")
    damped = F.aggregate(F.transform(weights, lambda w, i: w / ((i + 1) * (i + 1)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return (damped + top * (1 - 1 / (at * at))) / BASEL


def idf(n_all: Column, df: Column) -> Column:
    return F.log(1 + (n_all - df + 0.5) / (df + 0.5))


def query_lexemes(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select(F.explode(F.array_distinct(T.words(T.truncated_query(F.col(text))))).alias("lexeme")).distinct()


#: So many terms are looked for within the row; more meet the words in a join.
FEW_TERMS = 256


def matches(df: DataFrame, key: list[str], terms: DataFrame, text: str = "text", tf: str = "tsrank") -> DataFrame:
    """key, lexeme, tf, n for the query's lexemes. A question's terms are few: they become part of the plan, and only words that are hits leave their row.
    Larger sets of terms take an equi-join in place of a lateral loop."""
    few = [r[0] for r in terms.select("lexeme").limit(FEW_TERMS + 1).collect()]
    words = T.words(F.col(text))
    if len(few) <= FEW_TERMS:
        found = F.filter(words, lambda w: w.isin(few)) if few else F.array().cast("array<string>")
        hits = df.select(*key, F.explode(found).alias("lexeme"))
    else:
        hits = df.select(*key, F.explode(words).alias("lexeme")).join(terms, "lexeme")
    counted = hits.groupBy(*key, "lexeme").agg(F.count("*").alias("n"))
    return counted.withColumn("tf", ts_rank(F.col("n")) if tf == "tsrank" else F.col("n").cast("double"))


def bm25(hits: DataFrame, key: list[str], n_all: DataFrame) -> DataFrame:
    """key, s: summed tf / (tf + 1) * idf, and r: the summed occurrences, where the hits have them (n). n_all: one row with the number of candidate rows (n_all).

    Document frequencies are a groupBy joined back: a frequent lexeme is no hot window.
    """
    df = hits.groupBy("lexeme").agg(F.count("*").alias("df"))
    part = F.col("tf") / (F.col("tf") + 1) * idf(F.col("n_all"), F.col("df"))
    return hits.join(df, "lexeme").crossJoin(F.broadcast(n_all)).groupBy(*key).agg(F.sum(part).alias("s"), *([F.sum("n").cast("double").alias("r")] if "n" in hits.columns else []))


def lexemes_of(queries: DataFrame, most: int = FEW_TERMS) -> list[str]:
    """The lexemes of a query's rows, as a list: a query has few."""
    few = [r[0] for r in query_lexemes(queries).limit(most + 1).collect()]
    if len(few) > most:
        raise ValueError(f"more than {most} lexemes: search by matches()")
    return sorted(few)


def squashed(s: Column) -> Column:
    return s / (s + 1)


def proximity(hits: DataFrame, key: list[str]) -> DataFrame:
    """key, prox: cover density of an any-term query, where each occurrence is its own cover: the summed weights, r / (r + 1)."""
    return hits.groupBy(*key).agg(F.sum("n").cast("double").alias("r")).select(*key, squashed(F.col("r")).alias("prox"))


def blended(scores: DataFrame, prox: DataFrame | None, key: list[str]) -> DataFrame:
    """key, s, prox, score (0.8 of the squashed s, 0.2 of prox) and order_key (0.8 of the plain s). Without prox it is that of the scores' own r: no second pass over the hits."""
    if prox is None:
        both = scores.select(*key, "s", squashed(F.col("r")).alias("prox"))
    else:
        both = scores.select(*key, "s").join(prox, key, "left").withColumn("prox", F.coalesce("prox", F.lit(0.0)))
    return both.withColumn("score", 0.8 * squashed(F.col("s")) + 0.2 * F.col("prox")).withColumn("order_key", 0.8 * F.col("s") + 0.2 * F.col("prox"))


def best_per_document(df: DataFrame, doc: str, chunk: str) -> DataFrame:
    """The chunk of the highest order_key of each document: an aggregate with a struct, not a window, so partial results merge before the shuffle."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.round("order_key", 9), -F.col(chunk))).alias("best")
    return df.groupBy(doc).agg(best).select("best.*")


def top(df: DataFrame, score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of the highest score, ties to the smaller key, with their rank."""
    few = df.orderBy(F.desc(F.round(score, 9)), key).limit(k)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), key)))


def highlight(text: Column, terms: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """Whole words of the query wrapped; terms and marks are taken as they are, whatever signs they hold."""
    if not terms:
        return text
    plain = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])(" + "|".join(map(re.escape, terms)) + r")(?![A-Za-z0-9_])", f"{plain(start)}$1{plain(stop)}")
