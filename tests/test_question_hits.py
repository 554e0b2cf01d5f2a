"""Searches of a single question: from its hits, without an index of all words, and on files whose rows lie in one row group."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftlake.operators import keyword_index
from siftlake.plans import ORACLES, QUERIES, registry
from siftlake.sources import tables

LINE = "The Red wolf, l'été près de Straße 12.\n"
DOCS = [
    (0, "A red wolf page 7", "en", "web0"),
    (1, (LINE + "nothing here of note, only lines\n") * 60, "en", "web1"),
    (2, None, "de", "web2"),
    (3, "", "de", "web2"),
    (4, "the wolf has no source", None, None),
    (5, "unlike all others", "en", "page9"),
    (6, "wolf " * 700, "fr", "red3"),
]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    at = tmp_path_factory.mktemp("hits")
    ids, texts, langs, sources = zip(*DOCS)
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(docs), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["The red wolf of page 12, été ete strasse"]}), at / "benchmark.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": [[1.0, i, i * i % 5] for i in ids], "label": pa.array(ids, pa.int64())}), at / "embeddings.parquet")
    return str(at)


def same_rows(spark, at, name, leave_out=()):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    shown = lambda rows: sorted(repr(tuple(r)) for r in rows if r[0] not in leave_out)
    got = shown(QUERIES[name](spark, at).select(*want.columns).collect())
    assert got == shown(want.fetchall()) and got


@pytest.mark.parametrize("name", ["kw_blend", "adv_keyword", "kw_best_chunk_per_doc"])
def test_chunk_searches_take_no_index(spark, small, name):
    same_rows(spark, small, name)
    assert not tables.made(spark, "chunk_postings", small)


def test_hits_and_postings_give_the_same_scores(spark, tmp_path):
    rows = [(1, ["a", "b", "a"], ["a"]), (2, ["b"], ["c", "c"]), (3, ["x"], []), (4, [], [])]
    df, fields = spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), {"A": F.col("a"), "B": F.col("b")}
    asked = ["a", "b", "c", "none"]
    keyword_index.write_hits(df, "k", fields, asked, f"{tmp_path}/hits")
    hits = keyword_index.QuestionHits(spark, f"{tmp_path}/hits", "k")
    stored = keyword_index.build(df, "k", fields, f"{tmp_path}/index")
    shown = lambda d: {r.k: (round(r.s, 9), round(r.r, 9)) for r in d.collect()}
    assert shown(hits.all_scores()) == shown(stored.all_scores(asked)) and set(shown(hits.all_scores())) == {1, 2}
    assert [r.k for r in hits.top(1).collect()] == [r.k for r in stored.top(asked, 1).collect()]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "SPLIT_ROWS", 100)
    pq.write_table(pa.table({"doc_id": list(range(4000)), "text": [f"{i} {i * 7919 % 104729} words" for i in range(4000)]}), tmp_path / "one.parquet", row_group_size=4000, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.parquet(f"{tmp_path}/one.parquet")
        sizes = lambda d: sorted(r.n for r in d.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert df.rdd.getNumPartitions() > 2 and sizes(df) == [4000]
        assert len(sizes(registry.spread(df))) == 40 and max(sizes(registry.spread(df))) <= 120
        whole = spark.read.parquet(f"{tmp_path}/one.parquet").where("doc_id < 50")
        assert registry.spread(whole) is whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["kw_bm25_topk", "fuse_adv_rrf", "format_context"])
def test_document_searches_take_no_index(spark, small, name):
    # Without a source the context says None, as the front end's does, and the SQL's is null.
    same_rows(spark, small, name, (4,) if name == "format_context" else ())
    assert not tables.made(spark, "document_postings", small)
