"""Retrieval quality: hits of files and pages, and shares by flag."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import bound


WINDOW = 8
#: Questions, and hashes of them, that go to every task; those of more meet the texts' in a join.
FEW = 4096


def searched(questions: DataFrame, docs: DataFrame, item: str = "item_id") -> DataFrame | None:
    """item, doc_id, page: documents that hold a question's text, and the line where it first begins; by one pass over the texts, from which only these rows come. None for more than FEW questions.

    A question's inner words are words of any text that holds it, so its longest one leads to the few texts that are searched for the whole.
    """
    rows = questions.where("text IS NOT NULL").select(item, "text").limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return None
    items, asked, by = rows.column(0).combine_chunks(), rows.column(1).to_pylist(), defaultdict(list)
    for i, q in enumerate(asked):
        by[max(q.replace("\n", " ").split(" ")[1:-1], key=len, default=None)].append(i)
    every, probes = by.pop(None, []), dict(by)
    ids, kind = questions.schema[item].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, page = [], [], []
            for row, x in enumerate(b.column("text")):
                text = x.as_py()
                if text is None:
                    continue
                held = probes.keys() & set(text.replace("\n", " ").split(" "))
                for i in [*every, *(i for w in held for i in probes[w])]:
                    begin = text.find(asked[i])
                    if begin >= 0:
                        at.append(row)
                        place.append(i)
                        page.append(text.count("\n", 0, begin) + 1)
            yield pa.RecordBatch.from_arrays([items.take(pa.array(place, pa.int32())), b.column("doc_id").take(pa.array(at, pa.int32())), pa.array(page, pa.int32())], names=[item, "doc_id", "page"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{item} {ids}, doc_id {kind}, page int")


def contained(questions: DataFrame, docs: DataFrame, item: str = "item_id") -> DataFrame:
    """item, doc_id: documents that hold a question's text.

    A question's second to ninth words are whole words of any text that holds it (its first and last may be parts of words), so the texts'
    eight-word windows lead to the few candidates, which are then searched. Shorter questions go by their second word; those without an
    inner word are few and are searched for in every text. Few questions are searched for by one pass over the texts.
    """
    if (rows := searched(questions, docs, item)) is not None:
        return rows.select(item, "doc_id")
    parts = lambda c: F.split(c, "[ \n]")
    q = questions.select(item, F.col("text").alias("q"), parts(F.col("text")).alias("w")).where("q IS NOT NULL")
    size = F.size("w")
    probe = F.when(size >= WINDOW + 2, F.xxhash64(F.array_join(F.slice("w", 2, WINDOW), " "))).when(size >= 3, F.xxhash64(F.get("w", F.lit(1))))
    asked = q.select(item, "q", probe.alias("h"))

    def hashes(w: Column) -> Column:
        windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(WINDOW)), " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(windows, F.transform(F.array_distinct(w), lambda x: F.xxhash64(x)))

    # The split is bound once: inside of a function of windows it would run for each. Of few questions, only hashes that one of them has leave the row.
    every = bound(parts(F.col("text")), hashes)
    few = [r[0] for r in asked.where("h IS NOT NULL").select("h").distinct().limit(FEW + 1).collect()]
    places = docs.select("doc_id", F.explode(F.filter(every, lambda h: h.isin(few)) if 0 < len(few) <= FEW else every).alias("h"))
    near = places.join(asked.where("h IS NOT NULL").select(item, "h"), "h").select(item, "doc_id").distinct()
    texts = docs.select("doc_id", "text")
    found = near.join(texts, "doc_id").join(asked.select(item, "q"), item).where(F.contains("text", "q")).select(item, "doc_id")
    short = asked.where("h IS NULL")
    if short.limit(1).count():
        found = found.union(texts.join(short, F.contains("text", "q")).select(item, "doc_id"))
    return found


def first_pages(questions: DataFrame, docs: DataFrame, item: str = "item_id") -> DataFrame:
    """item, doc_id, page: documents that hold a question's text, and the line where it first begins."""
    if (rows := searched(questions, docs, item)) is not None:
        return rows
    held = contained(questions, docs, item).join(questions.select(item, F.col("text").alias("q")), item).join(docs, "doc_id")
    before = F.expr("substring(text, 1, locate(q, text) - 1)")
    return held.select(item, "doc_id", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("page"))


def hit_rate(found: DataFrame, gold: DataFrame, item: str = "item_id") -> DataFrame:
    """One row: questions with a gold document, how many have one among their results, the share, and the mean reciprocal rank."""
    best = gold.join(found, [item, "doc_id"], "left").groupBy(item).agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("n_questions"), F.count("rank").alias("n_hits"), F.round(100 * F.try_divide(F.count("rank"), F.count("*")), 6).alias("pct_hits"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def retrieval_rates(found: DataFrame, gold: DataFrame, item: str = "item_id") -> DataFrame:
    """One row: n_questions, pct_file and pct_page (questions with a result of a gold file, and on a gold page or one beside it), con_prob (of those with the file, how many also
    have the page) and mean_best (the mean of the questions' highest similarity). found: item, doc_id, page, similarity; gold: item, doc_id, page."""
    # A question's results are a page of them: they meet its gold documents as one row, so that both sides are made once.
    own = found.groupBy(item).agg(F.max("similarity").alias("best"), F.collect_list(F.struct("doc_id", "page")).alias("held"))
    same = lambda x: x["doc_id"] == F.col("doc_id")
    file, page = F.exists("held", same), F.exists("held", lambda x: same(x) & near_page(F.col("page"), x["page"]))
    each = gold.join(own, item, "left").groupBy(item).agg(F.max(file.cast("int")).alias("file"), F.max(page.cast("int")).alias("page"), F.max("best").alias("best"))
    file, page = F.coalesce(F.sum("file"), F.lit(0)), F.coalesce(F.sum("page"), F.lit(0))
    return each.agg(F.count("*").alias("n_questions"), F.round(100 * F.try_divide(file, F.count("*")), 6).alias("pct_file"), F.round(100 * F.try_divide(page, F.count("*")), 6).alias("pct_page"), F.round(F.try_divide(page, file), 6).alias("con_prob"), F.round(F.avg("best"), 6).alias("mean_best"))


def flag_shares(rows: DataFrame, hit: str, flags: list[str]) -> DataFrame:
    """flag, n, pct: the share of hits among the rows of each flag."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags]))
    return rows.select(hit, each.alias("x")).where("x.on = 1").groupBy("x.flag").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col(hit).cast("double")), 6).alias("pct"))


def near_page(a, b):
    return F.abs(a - b) <= 1


def source_counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, n_docs, n_pages: the different sources behind a result, and all its pages."""
    return rows.groupBy(*keys).agg(F.count_distinct(name).alias("n_docs"), F.count("*").alias("n_pages"))


def summary(answers: DataFrame, answer: str, latency: str, no_answer: str) -> DataFrame:
    """One row: n_questions, n_correct (answers without the text that says there is none), pct_correct, mean_latency."""
    correct = F.count_if(~F.contains(F.col(answer), F.lit(no_answer)))
    return answers.agg(F.count("*").alias("n_questions"), correct.alias("n_correct"), F.round(100.0 * F.try_divide(correct, F.count("*")), 6).alias("pct_correct"), F.round(F.avg(latency), 6).alias("mean_latency"))


def lengths_agree(pages: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """doc, pages_len, sections_len, whole: documents whose sections lost or doubled text are not whole."""
    both = pages.join(sections, doc, "left").select(doc, "pages_len", F.coalesce("sections_len", F.lit(0)).cast("long").alias("sections_len"))
    return both.withColumn("whole", F.col("pages_len") == F.col("sections_len"))
