"""Interfaces to models and services, with deterministic stand-ins.

A plug-in is a function of Columns. Real ones wrap a pandas UDF that loads its model once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T

#: Frequent words that tell languages apart.
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit", "den", "von"),
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "with", "was"),
    "es": ("el", "los", "que", "en", "una", "por", "con", "las", "su", "se"),
    "it": ("il", "che", "di", "una", "per", "non", "con", "gli", "della", "sono"),
    "fr": ("le", "les", "des", "est", "une", "dans", "pour", "que", "qui", "et"),
}


#: Languages that questions are answered in, and how many parts a question has that tells its language.
ANSWER_LANGUAGES = {"en": "English", "de": "German", "it": "Italian"}
LEAST_PARTS = 5


class Embedder(Protocol):
    dims: int

    def __call__(self, text: Column) -> Column: ...


class HashEmbedder:
    """Counts of hashed words, scaled to unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, text: Column) -> Column:
        at = F.transform(T.words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(self.dims)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))
        return T.bound(counts, lambda c: T.bound(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def overlap_reranker(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = F.array_distinct(T.words(query))
    return F.try_divide(F.size(F.array_intersect(q, T.words(text))), F.size(q))


def detected_language(text: Column, default: str = "en") -> Column:
    """The language with most frequent words in the text; ties to the first name."""
    words = T.words(text)
    votes = [F.struct((-F.size(F.filter(words, _among(ws)))).alias("n"), F.lit(k).alias("lang")) for k, ws in STOP_WORDS.items()]
    best = F.array_min(F.array(*votes))
    return F.when(best["n"] < 0, best["lang"]).otherwise(F.lit(default))


def _among(ws: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*ws)


def query_language(question: Column, previous: Column, raw: Column | None = None, supported: tuple[str, ...] = tuple(ANSWER_LANGUAGES)) -> Column:
    """Of the (rephrased) question if it is long enough and its language is supported. A short one goes by the first line of the last answer
    (the text behind its tag), where there is one; else the user's raw question decides. An unsupported language is an error."""
    lang, short = detected_language(question), F.size(F.split(question, " ")) < LEAST_PARTS
    said = F.regexp_extract(previous, r"\[AIMessage: \d+\](.*)", 1)
    by_raw = lang if raw is None else F.when(raw.isNotNull(), detected_language(raw)).otherwise(lang)
    told = F.when(previous.isNotNull() & (said != ""), detected_language(said)).otherwise(lang)
    lang = F.when(lang.isin(*supported) & ~short, lang).when(short & previous.isNotNull(), told).otherwise(by_raw)
    return F.when(lang.isin(*supported), lang).otherwise(F.raise_error(F.concat(F.lit("unsupported language "), lang)).cast("string"))


def summarised(text: Column, n: int = 60) -> Column:
    """Stand-in of a summary model."""
    return T.first_words(text, n)


def refined(df: DataFrame, draft: Callable[[Column], Column], critique: Callable[[Column], Column], text: str = "text", good: float = 8, most: int = 2) -> DataFrame:
    """summary, score, revision: drafts again while the score is below `good`, `most` times at most. A bounded chain of columns."""
    df = df.withColumns({"summary": draft(F.col(text)), "revision": F.lit(0)}).withColumn("score", critique(F.col("summary")))
    for _ in range(most):
        again = F.col("score") < good
        df = df.withColumns({"summary": F.when(again, draft(F.col("summary"))).otherwise(F.col("summary")), "revision": F.col("revision") + again.cast("int")}).withColumn("score", critique(F.col("summary")))
    return df


def routed(topic: Column, routes: dict[str, str], default: str) -> Column:
    """The chain of a topic; unknown topics go to the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]), topic), F.lit(default))


def translated(text: Column, lang: Column, target: str, model: Callable[[Column], Column]) -> Column:
    """Texts already in the target language stay."""
    return F.when(lang == target, text).otherwise(model(text))
