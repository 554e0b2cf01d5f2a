"""One way into the searches: a retriever of a search type over chunks, vectors and words; and what a chat does with its results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import chunking, fusion, keyword, merging, vector, web

#: The public names of search types.
SEARCH_TYPES = ("similarity", "similarity_score_threshold", "mmr", "advanced_search", "advanced_search_with_threshold")
MERGERS: dict[str, Callable[..., DataFrame]] = {"rrf": fusion.reciprocal_rank, "rescale": fusion.rescaled, "simple": fusion.simple}


@dataclass
class Retriever:
    """chunks: doc_id, chunk_id, chunk_num, chunk_text, embedding (and page, page_breaks for pages). Filters are applied by the caller or by `allowed`.

    An empty list of documents means no filter; so does None.
    """

    chunks: DataFrame
    search_type: str = "similarity"
    k: int = 20
    semantic_threshold: float | None = None
    keyword_threshold: float | None = None
    merging: str | Callable[..., DataFrame] = "rrf"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.search_type not in SEARCH_TYPES:
            raise ValueError(f"search_type is one of {SEARCH_TYPES}")
        if self.search_type.endswith("threshold") and not all(isinstance(x, float) for x in (self.semantic_threshold, self.keyword_threshold)):
            raise ValueError("a search by threshold needs both thresholds as floats")
        if isinstance(self.merging, str) and self.merging not in MERGERS:
            raise ValueError(f"merging is one of {tuple(MERGERS)} or a function")

    def allowed(self, ids: DataFrame | None) -> DataFrame:
        return self.chunks if ids is None or not ids.limit(1).count() else self.chunks.join(ids, "doc_id", "left_semi")

    def semantic(self, rows: DataFrame, q: list[float]) -> DataFrame:
        near = vector.nearest(rows.select("chunk_id", "embedding"), q, self.k, "chunk_id")
        return near.select("chunk_id", (1 - F.col("distance")).alias("score"), "rank")

    def words(self, rows: DataFrame, question: DataFrame) -> DataFrame:
        hits = keyword.matches(rows, ["chunk_id"], keyword.query_lexemes(question), "chunk_text")
        s = keyword.bm25(hits, ["chunk_id"], rows.agg(F.count("*").alias("n_all")))
        return keyword.top(s, "s", "chunk_id", self.k).select("chunk_id", keyword.squashed(F.col("s")).alias("score"), "rank")

    def documents(self, rows: DataFrame, q: list[float], question: DataFrame) -> DataFrame:
        """One chunk a document from either side, over its threshold (strictly), fused with more weight on words."""
        key = ["doc_id", "chunk_id"]
        hits = keyword.matches(rows, key, keyword.query_lexemes(question), "chunk_text")
        blend = keyword.blended(keyword.bm25(hits, key, rows.agg(F.count("*").alias("n_all"))), None, key)
        strict = lambda df, t: df if t is None else df.where(F.col("score") > t)
        by_words = strict(keyword.top(keyword.best_per_document(blend, "doc_id", "chunk_id"), "score", "doc_id", self.k), self.keyword_threshold)
        by_vector = vector.best_per_group(rows, q, "doc_id", self.k, "chunk_id").withColumn("score", 1 - F.col("distance"))
        by_vector = strict(by_vector, self.semantic_threshold)
        return fusion.reciprocal_rank(by_vector, by_words, "doc_id", 0.3).where(F.col("rank") <= self.k)

    def search(self, q: list[float], question: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """chunk_id (doc_id for advanced searches), score, rank."""
        rows = self.allowed(ids)
        if self.search_type.startswith("advanced"):
            return self.documents(rows, q, question)
        if self.search_type == "mmr":
            got = vector.maximal_marginal_relevance(rows.select("chunk_id", "embedding"), q, self.k, self.options.get("fetch_k", 20), "chunk_id", weight=self.options.get("lambda_mult", 0.5))
            return got.select("chunk_id", (1 - F.col("distance")).alias("score"), "rank")
        sides = [self.semantic(rows, q), self.words(rows, question)]
        for i, t in enumerate((self.semantic_threshold, self.keyword_threshold)):
            if t is not None:
                sides[i] = sides[i].where(F.col("score") >= t)
        merge = MERGERS[self.merging] if isinstance(self.merging, str) else self.merging
        return merge(*sides, "chunk_id").where(F.col("rank") <= self.k)


def chat_context(retriever: Retriever, q: list[float], question: DataFrame, names: DataFrame, *, most_tokens: int = 76_565, rerank: Callable[[Column], Column] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """From a question to the numbered context: search, re-rank, trim overlaps, cut to the budget, merge runs, cut by pages, order documents by score, format.

    names: doc_id, name, summary, and authors if they are known. One row a document, in the order of doc_rank; `merging.whole_context` joins them.
    """
    few = retriever.search(q, question, ids)
    chunks = retriever.chunks.drop("embedding")
    heading = "heading" if "heading" in chunks.columns else None
    # Neighbours of a page of hits: only their documents' chunks are windowed.
    hit = chunks.select("doc_id", "chunk_id").join(F.broadcast(few.select("chunk_id")), "chunk_id").select("doc_id").distinct()
    own = chunks.join(F.broadcast(hit), "doc_id", "left_semi")
    near = chunking.with_neighbours(own, ["doc_id"], "chunk_num", "chunk_text", heading=heading)
    rows = near.join(F.broadcast(few), "chunk_id")
    if rerank is not None:
        rows = rows.withColumn("score", rerank(F.col("chunk_text"))).where("score >= 0")
    trimmed = merging.trimmed_neighbours(rows)
    tokens = T.token_estimate(F.concat("previous", "chunk_text", "next")) + 40
    fits = merging.token_prefix(trimmed.withColumn("tokens", tokens), "tokens", most_tokens).where(F.col("rank") <= retriever.k)
    rows = rows.join(F.broadcast(fits.select("chunk_id")), "chunk_id", "left_semi")
    order = merging.document_order(rows, "doc_id", "score")
    merged = merging.in_context(merging.trimmed_neighbours(merging.merged_runs(rows, "doc_id", heading=heading), "text"), "text")
    pieces = merging.by_page(merged, ["doc_id", "run"], "text", "page", "page_breaks") if "page_breaks" in chunks.columns else merged.select("doc_id", "run", "page", F.col("text").alias("piece"))
    titled = merging.excerpts(pieces.join(F.broadcast(order), "doc_id").join(names, "doc_id"), "doc_rank", ["doc_id", "run", "page"])
    return merging.formatted_context(titled, "doc_id", "doc_rank", "piece", name="name", authors="authors" if "authors" in names.columns else None, description="summary")


def web_retrieval(question: DataFrame, results: DataFrame, stored: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The pages to store and the best chunks: results (url, date, html) of an external search that are not stored yet are parsed and cut,
    and ranked together with the stored chunks (url, date, chunk_no, chunk_text)."""
    new = results.join(web.new_urls(results, stored), ["url", "date"], "left_semi")
    pages = web.parsed(new).where(F.col("lang").isin(*web.WEB_LANGUAGES)).withColumn("key", F.struct("url", "date"))
    cut = chunking.uniform_chunks(pages.select("key", F.split("body", "\n").alias("pages")), "key", "pages").select("key.*", F.col("chunk_num").alias("chunk_no"), "chunk_text")
    every = stored.select("url", "date", "chunk_no", "chunk_text").unionByName(cut).withColumn("chunk", F.concat_ws("#", "url", F.col("date").cast("string"), F.col("chunk_no").cast("string")))
    terms = question.select(F.explode(F.array_distinct(T.usimple(T.clean_search_query(F.col("text"))))).alias("lexeme"))
    best = keyword.top(web.ranked(every, terms, "chunk", "chunk_text", keyword.ts_rank(F.col("n"))), "score", "chunk", k)
    return cut, every.join(F.broadcast(best), "chunk").select("url", "date", "chunk_no", "chunk_text", "score", "rank")
