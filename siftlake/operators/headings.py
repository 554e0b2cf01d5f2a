"""Headings of documents, found by the sizes of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_REPEATS = 3


def looks_like(line: Column) -> Column:
    """4 to 79 characters that do not begin with a lower-case letter or an opening bracket."""
    return F.length(line).between(4, 79) & ~line.rlike(r"^[a-z(\[{]")


def candidates(lines: DataFrame, doc: str, heading: str, size: str, levels: int) -> DataFrame:
    """lines that look like headings, with their level: the rank of their size. Texts seen over three times are dropped."""
    level = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(size)))
    seen = F.count("*").over(Window.partitionBy(doc, heading))
    return lines.where(looks_like(F.col(heading))).withColumns({"level": level, "_seen": seen}).where((F.col("_seen") <= MOST_REPEATS) & (F.col("level") <= levels)).drop("_seen")


def level_choice(lines: DataFrame, doc: str, heading: str, size: str, page: str, per: int = 3, pages: int = 1) -> DataFrame:
    """doc, level: the last level before the headings up to it outnumber `per` for each `pages` pages; 0 if the first does."""
    level = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(size)))
    n_pages = lines.groupBy(doc).agg(F.max(page).alias("_pages"))
    counts = lines.where(looks_like(F.col(heading))).withColumn("level", level).groupBy(doc, "level").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(doc).orderBy("level"))
    over = counts.join(n_pages, doc).withColumn("_over", upto * pages > per * F.col("_pages"))
    return over.groupBy(doc).agg(F.coalesce(F.min(F.when(F.col("_over"), F.col("level"))) - 1, F.max("level")).alias("level"))


def section_texts(docs: DataFrame, doc: str, pages: str, is_heading) -> DataFrame:
    """doc, line_no, heading, section_text: all within the document's row."""
    from siftlake.operators.chunking import running_ends

    full = docs.select(doc, F.array_join(pages, "").alias("t"), F.transform(F.arrays_zip(F.col(pages).alias("p"), running_ends(F.col(pages)).alias("e")), lambda x, i: F.struct((i + 1).alias("line_no"), x["p"].alias("heading"), (x["e"] - F.length(x["p"])).alias("off"))).alias("l"))
    marks = full.withColumn("h", F.filter("l", lambda x: is_heading(x["heading"])))
    stop = F.coalesce(F.get("h", F.col("i") + 1)["off"], F.length("t"))
    rows = marks.select(doc, "t", "h", F.posexplode("h").alias("i", "x"))
    return rows.select(doc, "x.line_no", "x.heading", F.substring(F.col("t"), F.col("x.off") + 1, stop - F.col("x.off")).alias("section_text"))


def merged_sections(sections: DataFrame, doc: str, order: str, level: str, text: str, lines: int = 4) -> DataFrame:
    """Short or lower sections joined to what follows: a group ends where the next level is higher or the text has enough lines."""
    w = Window.partitionBy(doc).orderBy(order)
    ends = (F.coalesce(F.lead(level).over(w) <= F.col(level), F.lit(True))) | (F.size(F.split(text, "\n")) >= lines)
    flagged = sections.withColumn("_ends", ends.cast("int"))
    group = F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = flagged.withColumn("section", group)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return grouped.groupBy(doc, "section").agg(F.min(order).alias(order), F.min(level).alias(level), F.array_join(parts, "\n").alias(text))
