"""Chat histories, token ledgers, latencies and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How turns are marked by their role.
TAGS = {"user": "HumanMessage", "assistant": "AIMessage"}


def tagged(history: DataFrame, conv: str, order: str) -> DataFrame:
    """history with n (the turn's number among those of its role, from 0) and line, as in [HumanMessage: 0]text. Empty texts and other roles go."""
    kept = history.where(F.col("role").isin(*TAGS) & (F.col("text") != ""))
    n = F.row_number().over(Window.partitionBy(conv, "role").orderBy(order)) - 1
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.col("role"))
    return kept.withColumn("n", n).withColumn("line", F.format_string("[%s: %d]%s", tag, "n", "text"))


def pairs(history: DataFrame, conv: str, order: str) -> DataFrame:
    """conv, pair (from 0), question, answer: an assistant turn and the user turn right before it."""
    w = Window.partitionBy(conv).orderBy(order)
    said = history.withColumns({"_role": F.lag("role").over(w), "question": F.lag("text").over(w)})
    both = said.where((F.col("role") == "assistant") & (F.col("_role") == "user"))
    return both.select(conv, (F.row_number().over(w) - 1).alias("pair"), "question", F.col("text").alias("answer"))


def as_text(pairs_: DataFrame, conv: str) -> DataFrame:
    part = F.concat(F.lit("Question: "), "question", F.lit(" \n Answer: "), "answer")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pair", part.alias("p")))), lambda x: x["p"])
    return pairs_.groupBy(conv).agg(F.array_join(parts, "\n").alias("history"))


def within_budget(pairs_: DataFrame, conv: str, tokens: Column, most: int) -> DataFrame:
    """The newest whole pairs whose tokens fit; older ones go."""
    back = Window.partitionBy(conv).orderBy(F.desc("pair")).rowsBetween(Window.unboundedPreceding, 0)
    return pairs_.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(back)).where(F.col("running") <= most)


def last_turns(history: DataFrame, conv: str, order: str, n: int = 6) -> DataFrame:
    return history.withColumn("_back", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")


def ledger(events: DataFrame, model: str, prompt: Column, completion: Column) -> DataFrame:
    return events.groupBy(model).agg(F.round(F.sum(prompt), 2).alias("prompt_tokens"), F.round(F.sum(completion), 2).alias("completion_tokens"), F.count("*").alias("n_calls"))


def latencies(events: DataFrame, request: str, time: str, order: str) -> DataFrame:
    """events with seconds until the request's next stage; null for its last."""
    w, micros = Window.partitionBy(request).orderBy(order), F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("seconds", F.round(F.lead(micros).over(w) / 1e6 - micros / 1e6, 3))


def quota(usage: DataFrame) -> DataFrame:
    """allowed and code: words or credits over their limit refuse; credits name the reason if both do."""
    words, credits = F.col("words") > F.col("word_limit"), F.col("credits") > F.col("credit_limit")
    return usage.withColumns({"allowed": ~(words | credits), "code": F.when(credits, "CREDIT_LIMIT").when(words, "WORD_LIMIT")})
