"""Many questions at once: from the counts of one pass over the texts, against the stored postings, the JVM's words and SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftlake.functions import pywords
from siftlake.functions import text as T
from siftlake.operators import chunking, evaluation, many_questions
from siftlake.plans import ORACLES, QUERIES, search
from siftlake.sources import tables

LINE = "The Red wolf, l'été près de Straße 12, ÆON œuvre x_y ½ m² ªbc.\n"
TEXTS = [
    "A red wolf page 7",
    LINE * 60 + "the last line holds a heron and an otter, no more\n" + "filler words follow here\n" * 80,
    None,
    "",
    "the wolf has no source",
    "\n\n\n",
    "wolf " * 700,
    "“quoted” – the wolf ΟΔΟΣ İstanbul Ǆ 漢字 ꟋX ࡰࡰ sea\n" * 50,
    *["copies of the red wolf and the heron\nover two lines"] * 5,
    "no  gap\nred wolf at the\nend of a text",
]
ASKED = ["The red wolf of page 12, été ete strasse", "heron and an otter, no more", "copies of the red wolf and the heron\nover two", "wolf", "", None, "no  gap", "istanbul οδος ɤx 漢字 web 3 txt", "of nothing known, xyzzy", "wolf at the\nend of"]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    at = tmp_path_factory.mktemp("many")
    n = len(TEXTS)
    docs = {"doc_id": pa.array(range(n), pa.int64()), "text": TEXTS, "lang": ["en"] * n, "source": [None if i == 4 else f"web{i}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())}
    pq.write_table(pa.table(docs), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(ASKED)), pa.int64()), "text": ASKED}), at / "benchmark.parquet")
    return str(at)


def terms(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return b.select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("lexeme"))


def shown(df):
    return {(r.item_id, r["rank"], r.chunk_id): r.s for r in df.collect()}


def test_words_are_those_of_the_jvm(spark):
    # A character between words, alone and twice; some are letters to only one of the two.
    odd = [*range(0x20, 0x500), *range(0x860, 0x8D0), *range(0x1E90, 0x1EA0), *range(0x2000, 0x2200), 0x1C89, *range(0xA7C0, 0xA7E0), 0x6F22, 0x1D7CE, 0x10D50, 0x323AF]
    texts = [t for c in map(chr, odd) for t in (f"Été {c} b{c}{c}1 Straße{c}", f"x{c}y œuvre")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w"), T.usimple(F.col("t")).alias("u")).collect()
    letters = pywords.letters(spark)
    analyzer = letters.analyzer()
    held = lambda t: [w.decode("latin-1") if isinstance(w, bytes) else w for w in analyzer(t)(t)]
    assert [(r.t, letters.words(r.t), held(r.t)) for r in rows] == [(r.t, r.w, r.u) for r in rows]


def test_letters_that_only_the_jvm_knows():
    known = {i for i in range(0x80, 0x110000) if chr(i).isalnum()} - {0x6F22} | {0x2013}
    letters = pywords.compared(known, {i: chr(i).lower() for i in range(0x80, 0x110000) if chr(i).lower() != chr(i)} | {0x2014: "a"})
    assert (letters.odd, letters.extra) == ({0x6F22: " ", 0x2013: "–", 0x2014: "a"}, "–")
    assert letters.analyzer()("x–y 漢字—é")("x–y 漢字—é") == ["x–y", "字ae"]


def test_chunks_are_those_of_the_expressions(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    docs = spark.createDataFrame(rows, "k int, t string").select("k", F.split("t", "\n").alias("pages"))
    want = [(r.k, r.chunk_num, r.page, r.chunk_text) for r in chunking.uniform_chunks(docs, "k", "pages").orderBy("k", "chunk_num").collect()]
    assert [(k, *c) for k, t in rows for c in many_questions.cut(t)] == want and len(want) > 12


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_hits_and_postings_give_the_same_best_chunks(spark, small, monkeypatch, block):
    monkeypatch.setattr(many_questions, "BLOCK", block)
    asked = terms(spark, small)
    best, docs = search.best_chunks(spark, small, asked, "item_id", 3)
    monkeypatch.setattr(many_questions, "MOST", 3)
    stored, every = search.best_chunks(spark, small, asked, "item_id", 3)
    assert shown(best) == pytest.approx(shown(stored), abs=1e-9) and len(shown(best)) > 12
    assert {r.chunk_id // 10000 for r in best.collect()} == {r.doc_id for r in docs.collect()} and every.count() == len(TEXTS)


def test_texts_that_hold_a_question(spark, small, monkeypatch):
    questions, docs = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("benchmark", "documents"))
    want = sorted((i, d, t[: t.find(q)].count("\n") + 1) for i, q in enumerate(ASKED) for d, t in enumerate(TEXTS) if None not in (q, t) and q in t)
    pages = lambda: sorted(map(tuple, evaluation.first_pages(questions, docs).select("item_id", "doc_id", "page").collect()))
    held = lambda: sorted(map(tuple, evaluation.contained(questions, docs).select("item_id", "doc_id").collect()))
    assert pages() == want and held() == [w[:2] for w in want] and len(want) > 20
    monkeypatch.setattr(evaluation, "FEW", 3)
    assert pages() == want and held() == [w[:2] for w in want]


def test_eval_retrieval_takes_no_index(spark, small, tmp_path):
    # Another path, for which nothing is written yet; SQL has its own places of an empty text.
    for t in ("documents", "benchmark"):
        rows = pq.read_table(f"{small}/{t}.parquet")
        pq.write_table(rows.filter(pa.array([x != "" for x in rows.column("text").to_pylist()])), tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.sql(ORACLES["eval_retrieval"])
    assert [tuple(r) for r in QUERIES["eval_retrieval"](spark, str(tmp_path)).select(*want.columns).collect()] == want.fetchall()
    assert not tables.made(spark, "chunk_postings", str(tmp_path))


def test_eval_retrieval_of_no_documents_or_questions(spark, small, tmp_path):
    for empty in ("documents", "benchmark"):
        at = tmp_path / empty
        at.mkdir()
        for t in ("documents", "benchmark"):
            rows = pq.read_table(f"{small}/{t}.parquet")
            pq.write_table(rows.slice(0, 0) if t == empty else rows, at / f"{t}.parquet")
        assert [tuple(r) for r in QUERIES["eval_retrieval"](spark, str(at)).collect()] == [(0, None, None, None, None)]
