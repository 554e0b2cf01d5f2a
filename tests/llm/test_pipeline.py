"""The pipeline's stages against what they should keep."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import queries
from siftlake.llm.common import Scratch, dropping
from siftlake.llm.quality_rules import Cascade, Text

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, n = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns
        n.append(kept.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0 and n[3] == n[4]
    pieces = corpus_pipeline.pack(spark, kept, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.select("doc_id").collect()}
    ran = corpus_pipeline.run(spark, sf)
    with dropping():  # a second run and its end leave the first one's result alone
        again = corpus_pipeline.run(spark, sf).collect()
    ran = ran.collect()
    assert sorted((r.doc_id, r.start, r.length) for r in ran) == sorted((r.doc_id, r.start, r.length) for r in pieces) == sorted((r.doc_id, r.start, r.length) for r in again)


def test_dropping(spark):
    with dropping():
        kept = Scratch(spark).keep(spark.range(3).toDF("x"), "t")
        assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND"):
        kept.count()


def test_near_dedup_with_repeated_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near_b = b.replace("b59", "other")
    rows = [(1, a), (1, a), (5, a), (2, b), (5, c), (5, near_b), (7, d), (7, c), (7, d), (None, d), (None, "lone words"), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (5, c), (7, d), (None, "lone words"), (8, ""), (8, "")], key=str)


GOOD = "The quiet harbour lay under a pale morning sky while the boats came home. Every captain told a different story about the storm, and nobody doubted them.\n"
#: Null, empty, blank, short, long and repeated texts, null ids, ties.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, GOOD * 3), (5, GOOD * 3), (5, GOOD * 3), (6, "".join(f"Word{i} said about thing{i} plainly.\n" for i in range(20000))), (7, "ü 日本 \x00 # $"), (8, "mail me at some.body@example.com " + " ".join(f"reason{i}" for i in range(80)))]
CLASH = {"kept": "long", "failed_rule": "long", "base_failed": "string", "score": "string", "features": "long", "row_no": "string", "id": "string", "sig": "long", "component_id": "string", "curve": "string", "ids": "long", "row": "string", "doc": "string", "part": "long", "n_words": "string"}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(7).cast(t).alias(c) for c, t in CLASH.items()]).repartition(3)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_on_odd_rows(spark, sf, odd, name):
    got = STAGES[name](spark, odd, sf)
    assert got.schema.names == odd.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    assert all(str(r[c]) == "7" for r in rows for c in CLASH)
    key = lambda x: (str(x[0]), str(x[1]))
    have = sorted([(r.doc_id, r.text) for r in rows], key=key)
    if name == "quality rules":
        cascade = Cascade()
        assert have == sorted([x for x in ODD if not cascade.fails(Text(x[1]))], key=key)
        assert {x[0] for x in have} >= {6, 8}
    elif name == "quality classifier":
        assert set(have) <= set(ODD) and all(have.count(x) in (0, ODD.count(x)) for x in set(ODD))
    elif name == "near-dedup":
        assert have == sorted([x for i, x in enumerate(ODD) if i not in (4, 6)], key=key)
    else:
        assert len(have) == len(ODD) and {x for x in have if x[0] != 8} == {x for x in ODD if x[0] != 8}
        text = dict(have)[8]
        assert re.fullmatch(r"mail me at [a-z]{4}\.[a-z]{4}@example\.com .*", text) and "some.body" not in text
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    empty = STAGES[name](spark, odd.where("false"), sf)
    assert empty.columns == odd.columns and empty.count() == 0


def test_packing_on_odd_rows(spark, sf, odd):
    rows = corpus_pipeline.pack(spark, odd, sf).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert {k[0] for k in whole} == {x[0] for x in ODD} and whole[(1, 1)] == whole[(2, 1)] == [(0, 1)]
    assert sum(r.length for r in rows) == sum(n * (2 if i == 5 else 1) for i, n in whole)
    assert corpus_pipeline.pack(spark, odd.where("false"), sf).count() == 0


def test_classifier_without_labels_keeps_nothing(spark, tmp_path, odd):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.classifier(spark, odd, f"file://{tmp_path}").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
