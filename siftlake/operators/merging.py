"""What happens to retrieved chunks: overlaps, runs, merging, pages, budgets and the context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import bound, overlap

GAPS = (1, 2, 3)


def trimmed_neighbours(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """previous without what the chunk repeats, next without what it repeats of the chunk; page breaks, where they are there, move with the texts."""
    some = F.length(text) > 0
    kept = F.length("previous") - F.length(overlap(F.col("previous"), F.col(text)))
    gone = F.when(some, F.length(overlap(F.col(text), F.col("next")))).otherwise(0)
    df = df.withColumns({"_kept": kept, "_gone": gone})
    new = {"previous": F.substring(F.col("previous"), F.lit(1), F.col("_kept")), "next": F.substring(F.col("next"), F.col("_gone") + 1, F.length("next"))}
    if "previous_breaks" in df.columns:
        new |= {"previous_breaks": F.filter("previous_breaks", lambda b: some & (b < F.col("_kept"))), "next_breaks": F.transform(F.filter("next_breaks", lambda b: b > F.col("_gone")), lambda b: b - F.col("_gone"))}
    return df.withColumns(new).drop("_kept", "_gone")


def runs(chunks: DataFrame, doc: str, number: str, heading: str | None = None) -> DataFrame:
    """chunks with run: a number that grows where the gap to the chunk before is not 1 to 3, or the heading changes."""
    w = Window.partitionBy(doc).orderBy(number)
    gap = F.col(number) - F.lag(number).over(w)
    same = F.coalesce(gap.isin(*GAPS), F.lit(False))
    if heading:
        same = same & F.col(heading).eqNullSafe(F.lag(heading).over(w))
    return chunks.withColumn("run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_runs(chunks: DataFrame, doc: str, number: str = "chunk_num", text: str = "chunk_text", heading: str | None = None) -> DataFrame:
    """doc, run, first, last, text, page, page_breaks, and the neighbours (with breaks) before the first and behind the last chunk: a run's chunks in one text, with
    the neighbours that fill the gaps. The neighbours are given whole (not trimmed).

    Chunks that know their start are joined by their places; others by what their texts have in common (in texts that repeat themselves that may be too much).
    A gap of 1 adds the next text's new part; of 2 the neighbour between them; of 3 both neighbours. No text is lost or doubled.
    Runs have at most a page of results, so each is folded in one expression.
    """
    none = F.array().cast("array<int>")
    given = lambda c, other: F.col(c) if c in chunks.columns else other
    parts = F.struct(
        F.col(number).alias("n"), F.col(text).alias("t"), given("page_breaks", none).cast("array<int>").alias("b"), given("page", F.lit(None).cast("int")).cast("int").alias("page"),
        "previous", given("previous_breaks", none).cast("array<int>").alias("pb"), "next", given("next_breaks", none).cast("array<int>").alias("nb"),
        *[given(c, F.lit(None)).cast("int").alias(n) for c, n in (("start", "at"), ("previous_start", "pat"), ("next_start", "nat"))],
    )
    rows = runs(chunks, doc, number, heading).groupBy(doc, "run").agg(F.array_sort(F.collect_list(parts)).alias("c"))

    # The text begins at the start of the run's first chunk.
    origin = F.element_at("c", 1)["at"]

    def added(s: Column, t: Column, breaks: Column, at: Column) -> Column:
        """struct(t, b) with the new part of a text."""
        new = lambda x, o: F.struct(F.concat(x["t"], F.substring(t, o + 1, F.length(t))).alias("t"), F.concat(x["b"], F.transform(F.filter(breaks, lambda b: b >= o), lambda b: b - o + F.length(x["t"]))).alias("b"))
        common = lambda x: F.when((at - origin).between(0, F.length(x["t"])), F.least(origin + F.length(x["t"]) - at, F.length(t))).otherwise(F.length(overlap(x["t"], t)))
        return bound(s, lambda x: bound(common(x), lambda o: new(x, o)))

    def step(s: Column, x: Column) -> Column:
        gap = x["n"] - s["n"]
        begun = F.struct(s["t"].alias("t"), s["b"].alias("b"))
        near = bound(begun, lambda y: F.when(gap >= 2, added(y, s["next"], s["nb"], s["nat"])).otherwise(y))
        filled = bound(near, lambda y: F.when(gap == 3, added(y, x["previous"], x["pb"], x["pat"])).otherwise(y))
        return bound(added(filled, x["t"], x["b"], x["at"]), lambda y: F.struct(x["n"].alias("n"), y["t"].alias("t"), y["b"].alias("b"), x["next"].alias("next"), x["nb"].alias("nb"), x["nat"].alias("nat")))

    begin, end = F.element_at("c", 1), F.element_at("c", -1)
    folded = F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.struct(*[begin[k].alias(k) for k in ("n", "t", "b", "next", "nb", "nat")]), step)
    out = rows.withColumn("x", folded)
    return out.select(doc, "run", begin["n"].alias("first"), end["n"].alias("last"), F.col("x.t").alias("text"), begin["page"].alias("page"), F.col("x.b").alias("page_breaks"), begin["previous"].alias("previous"), begin["pb"].alias("previous_breaks"), end["next"].alias("next"), end["nb"].alias("next_breaks"))


def by_page(df: DataFrame, keep: list[str], text: str, page: str, breaks: str) -> DataFrame:
    """keep, page, piece: a text cut at its page breaks."""
    end = F.length(text)
    points = F.concat(F.array(F.lit(0)), F.col(breaks), F.when(F.coalesce(F.try_element_at(breaks, F.lit(-1)) == end, F.lit(False)), F.array().cast("array<int>")).otherwise(F.array(end)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_points") - 1), lambda i: F.struct((F.col(page) + i - 1).alias("page"), F.substring(F.col(text), F.element_at("_points", i) + 1, F.element_at("_points", i + 1) - F.element_at("_points", i)).alias("piece")))
    return df.withColumn("_points", points).select(*keep, F.explode(pieces).alias("x")).select(*keep, "x.page", "x.piece")


def in_context(df: DataFrame, text: str, page: str = "page", breaks: str = "page_breaks") -> DataFrame:
    """The text with its trimmed neighbours around it, its breaks and first page moved to match: what by_page cuts."""
    df = df.withColumns({"_before": F.length("previous"), "_own": F.length("previous") + F.length(text)})  # first: inside of functions a name may mean the new column
    moved = F.concat("previous_breaks", F.transform(breaks, lambda b: b + F.col("_before")), F.transform("next_breaks", lambda b: b + F.col("_own")))
    return df.withColumns({"_moved": moved, "_first": F.col(page) - F.size("previous_breaks")}).withColumns({text: F.concat("previous", text, "next"), breaks: F.col("_moved"), page: F.col("_first")}).drop("_before", "_own", "_moved", "_first")


def same_page(pieces: DataFrame, keep: list[str], order: str) -> DataFrame:
    """Pieces of one page joined by an ellipsis on a line of its own."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"])
    return pieces.groupBy(*keep, "page").agg(F.array_join(parts, "\n\n...\n\n").alias("piece"))


def numbered(rows: DataFrame, order: str, key: str, name: str, *, falling: bool = False, cuts: int = 128) -> DataFrame:
    """rows with their number by `order`, ties to the smaller key (a whole number), however many rows there are.

    Approximate quantiles cut the order into some hundred ranges, and rows of one frequent value by the key; the counts of the ranges (the only thing that
    comes to the driver with the cuts, both of bounded number) give where each begins, and windows number the rows within them.
    """
    marks = [i / cuts for i in range(1, cuts)]
    at, keys = rows.agg(F.percentile_approx(order, marks, 10000), F.percentile_approx(key, marks[:: max(1, cuts // 16)], 10000)).first()
    at, keys = sorted(set(at or [])), sorted(set(keys or []))
    below = lambda c, points: F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p < c)) if points else F.lit(0)
    same = F.col(order).isin(at) if at else F.lit(False)
    placed = rows.withColumns({"_range": below(F.col(order), at) * 2 + F.when(same, 0).otherwise(1 if falling else -1) * (-1 if falling else 1), "_part": F.when(same, below(F.col(key), keys)).otherwise(0)})
    counts = sorted((tuple(r) for r in placed.groupBy("_range", "_part").count().collect()), key=lambda r: (-r[0] if falling else r[0], r[1]))
    base, total = [], 0
    for r, p, n in counts:
        base.append((r, p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(base, "_range int, _part int, _before long")
    w = Window.partitionBy("_range", "_part").orderBy(F.desc(order) if falling else order, key)
    return placed.withColumn("_n", F.row_number().over(w)).join(F.broadcast(starts), ["_range", "_part"]).withColumn(name, (F.col("_n") + F.col("_before")).cast("int")).drop("_range", "_part", "_n", "_before")


def document_order(chunks: DataFrame, doc: str, score: str, page: bool = True) -> DataFrame:
    """doc, doc_score, doc_rank by the sum of the chunks' scores. page: the documents are a page of results, few enough for one task."""
    sums = chunks.groupBy(doc).agg(F.round(F.sum(score), 6).alias("doc_score"))
    return sums.withColumn("doc_rank", F.row_number().over(Window.orderBy(F.desc("doc_score"), doc))) if page else numbered(sums, "doc_score", doc, "doc_rank", falling=True)


def token_prefix(ranked: DataFrame, tokens: str, most: int, rank: str = "rank", group: list[str] = ()) -> DataFrame:
    """The longest prefix whose tokens sum to `most` at most."""
    w = Window.partitionBy(*group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") <= most)


#: The answer without documents.
NOTHING = "NO RELEVANT DOCUMENTS FOUND"


def _said(c: str | None) -> Column:
    return F.lit("None") if c is None else F.coalesce(F.col(c).cast("string"), F.lit("None"))


def excerpts(chunks: DataFrame, doc_rank: str, order: list[str]) -> DataFrame:
    """A page of results with excerpt: numbers through all documents in their order. They are the citations of the source list."""
    return chunks.withColumn("excerpt", F.row_number().over(Window.orderBy(doc_rank, *order)))


# The marks and headers of the contexts below.


def formatted_context(numbered_: DataFrame, doc: str, doc_rank: str, text: str, *, name: str, authors: str | None, description: str, heading: str | None = None) -> DataFrame:
    """doc, doc_rank, context, first_excerpt, last_excerpt: a header, and the excerpts of `excerpts` with their headings, for each document."""
    title = F.when(F.length(heading) > 0, F.concat(F.lit("Excerpt heading: "), heading, F.lit("\n"))).otherwise("") if heading else F.lit("")
    part = F.concat(F.lit("\n[Excerpt: "), F.col("excerpt").cast("string"), F.lit("]\n"), title, F.col(text), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("excerpt", part.alias("p")))), lambda x: x["p"])
    first = lambda c: F.min_by(_said(c), "excerpt")
    head = F.concat(F.lit("<Document Start>\nDocument name: "), first(name), F.lit("\nDocument authors: "), first(authors), F.lit("\nDocument description: "), first(description), F.lit("\n"))
    return numbered_.groupBy(doc).agg(F.min(doc_rank).alias(doc_rank), F.concat(head, F.array_join(parts, ""), F.lit("<Document End>")).alias("context"), F.min("excerpt").alias("first_excerpt"), F.max("excerpt").alias("last_excerpt"))


def formatted_web_context(chunks: DataFrame, doc: str, doc_rank: str, text: str, url: str, description: str, order: str) -> DataFrame:
    """doc, doc_rank, context: one excerpt number for each document, its chunks line by line, whole."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(text), F.lit("\n")).alias("p")))), lambda x: x["p"])
    docs = chunks.groupBy(doc).agg(F.min(doc_rank).alias(doc_rank), F.min_by(_said(url), order).alias("_url"), F.min_by(_said(description), order).alias("_about"), F.array_join(parts, "").alias("_text"))
    n = F.row_number().over(Window.orderBy(doc_rank)).cast("string")
    return docs.select(doc, doc_rank, F.concat(F.lit("<Document Start>\nDocument URL: "), "_url", F.lit("\nDocument description: "), "_about", F.lit("\n\n[Excerpt: "), n, F.lit("] "), "_text", F.lit("<Document End>\n\n")).alias("context"))


def whole_context(documents: DataFrame, doc_rank: str = "doc_rank") -> DataFrame:
    """One row: the documents' contexts in their order, or the answer that there are none."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(doc_rank, "context"))), lambda x: x["context"])
    return documents.groupBy().agg(F.when(F.count("*") > 0, F.array_join(parts, "")).otherwise(F.lit(NOTHING)).alias("context"))


def sources(numbered_: DataFrame, keep: list[str]) -> DataFrame:
    """What is cited: the kept columns of each excerpt with its number as text."""
    return numbered_.select(*keep, F.col("excerpt").cast("string").alias("citation"))


def budgets(context: Column, used: Column, answer: int = 0, fixed: int = 1300) -> tuple[Column, Column]:
    """Tokens for documents and for history: five and three eighths of what is left."""
    left = context - used - fixed - answer
    return F.floor(left * 5 / 8).cast("int"), F.floor(left * 3 / 8).cast("int")
