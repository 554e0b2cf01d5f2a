"""Web pages: text and metadata of HTML, page store, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T

#: Languages that web search answers in, and the named entities that are read.
WEB_LANGUAGES = ("fr", "en", "de", "nl", "da", "fi", "hu", "it", "no", "pt", "ro", "ru", "es", "sv", "tr")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(html: Column) -> Column:
    return unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def description(html: Column) -> Column:
    """Of the meta tag; null if there is none."""
    return F.nullif(F.regexp_extract(html, r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)", 1), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1)), F.lit(""))


def markdown(html: Column) -> Column:
    """Headings, list items and paragraphs as lines; links keep their text, images, scripts and styles go."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", "")
    for i in (1, 2, 3):
        t = F.regexp_replace(t, rf"(?is)<h{i}\b[^>]*>(.*?)</h{i}>", "\n" + "#" * i + " $1\n")
    t = F.regexp_replace(t, r"(?is)<li\b[^>]*>", "\n* ")
    t = F.regexp_replace(t, r"(?is)<br\s*/?>|</?(?:p|div|ul|ol|article|nav|section|table|tr|footer|header|h[4-6])\b[^>]*>", "\n")
    t = unescaped(F.regexp_replace(t, r"(?is)<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n\s*", "\n"))


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumns({"title": title(F.col(html)), "description": description(F.col(html)), "lang": language(F.col(html)), "body": markdown(F.col(html))}).drop(html)


def new_urls(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, date) that are asked for and not stored: a page is fetched once a day."""
    return asked.select("url", "date").subtract(stored.select("url", "date"))


def ranked(pages: DataFrame, terms: DataFrame, key: str, text: str, rank: Column) -> DataFrame:
    """key, score: r / (r + 1) of the summed damped frequencies of the query's lexemes, averaged over the plain and the language's own analyzer (here the plain one without accents)."""
    def side(lexemes: Column, name: str) -> DataFrame:
        hits = pages.select(key, F.explode(lexemes).alias("lexeme")).join(terms, "lexeme").groupBy(key, "lexeme").agg(F.count("*").alias("n"))
        return hits.groupBy(key).agg(F.sum(rank).alias("r")).select(key, (F.col("r") / (F.col("r") + 1)).alias(name))

    both = side(T.words(F.col(text)), "plain").join(side(T.usimple(F.col(text)), "folded"), key, "full_outer")
    return both.select(key, ((F.coalesce("plain", F.lit(0.0)) + F.coalesce("folded", F.lit(0.0))) / 2).alias("score"))
