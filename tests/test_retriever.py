"""Whole searches over the smallest tables."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.functions import files_crypto, tokens
from siftlake.functions.plugins import overlap_reranker
from siftlake.operators import vector
from siftlake.plans.retriever import Retriever, chat_context, web_retrieval
from siftlake.plans.search import chunks, documents, question


@pytest.fixture(scope="module")
def store(spark, sf):
    docs = documents(spark, sf)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = chunks(docs).join(e, "doc_id").cache()
    return docs, rows, vector.query_vector(e, "doc_id", 0), question(spark, sf)


def test_search_types(store, spark):
    _, rows, q, text = store
    for kind in ("similarity", "mmr", "advanced_search"):
        got = Retriever(rows, kind, k=5).search(q, text).collect()
        assert len(got) == 5 and sorted(r["rank"] for r in got)[0] == 1
    high = Retriever(rows, "similarity_score_threshold", k=5, semantic_threshold=0.99, keyword_threshold=0.99999).search(q, text).collect()
    assert 0 < len(high) <= 5
    few = Retriever(rows, k=5).search(q, text, spark.createDataFrame([(3,)], "doc_id long"))
    assert {r.chunk_id // 10000 for r in few.collect()} == {3}
    assert Retriever(rows, k=5).search(q, text, spark.createDataFrame([], "doc_id long")).count() == 5
    assert Retriever(rows.where("false"), k=5).search(q, text).count() == 0
    with pytest.raises(ValueError):
        Retriever(rows, "other")
    with pytest.raises(ValueError):
        Retriever(rows, "similarity_score_threshold", semantic_threshold=1)


def test_chat_context(store):
    docs, rows, q, text = store
    got = chat_context(Retriever(rows, k=6), q, text, docs.select("doc_id", "name", "summary"), rerank=lambda t: overlap_reranker(F.lit("the of and"), t)).collect()
    assert got and all("[Excerpt: " in r.context and r.context.startswith("<Document Start>\nDocument name: src") and r.context.endswith("<Document End>") for r in got)
    by_rank = sorted(got, key=lambda r: r.doc_rank)
    assert by_rank[0].first_excerpt == 1 and all(b.first_excerpt == a.last_excerpt + 1 for a, b in zip(by_rank, by_rank[1:]))


def test_web_retrieval(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("date", F.lit("2024-01-02").cast("date"))
    stored = spark.createDataFrame([], "url string, date date, chunk_no int, chunk_text string")
    text = spark.createDataFrame([('1. "the and"',)], "text string")
    new, best = web_retrieval(text, pages, stored, 5)
    assert best.count() == 5 and new.select("url").distinct().count() == pages.count()
    again, _ = web_retrieval(text, pages, new, 5)
    assert again.count() == 0


def test_tokens(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("hello world, hello",), (None,), ("",)], "t string")
    got = df.select(tokens.counter(ranks, public_tokenizers.PATTERN)("t").alias("n"), tokens.truncator(ranks, public_tokenizers.PATTERN, 2)("t").alias("c")).collect()
    assert [r.n for r in got] == [4, 0, 0] and got[0].c == "hello world"


def test_block_files():
    flip = lambda b: bytes(x ^ 7 for x in b)
    data = files_crypto.written(iter([b"abc", b"", b"defgh"]), flip)
    assert files_crypto.read(data, flip) == b"abcdefgh"
    with pytest.raises(ValueError):
        files_crypto.read(data[:-1], flip)
    assert len(files_crypto.derived_key(b"s", b"salt", 10)) == 32
