import pytest
from pyspark.sql import functions as F

from siftlake.functions import values as V
from siftlake.operators import evaluation
from siftlake.plans import QUERIES


def one(spark, col, schema="id int", row=(1,)):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_nulls_and_empty_values(spark):
    assert one(spark, V.unquoted(F.lit("'\"it's\"'"))) == "it's"
    assert one(spark, V.unquoted(F.lit("\"'"))) == ""
    assert one(spark, V.looked_up(F.lit("xx"), V.LANGUAGES)) is None
    assert one(spark, V.looked_up(F.lit("xx"), {})) is None
    assert tuple(one(spark, V.error_record(F.lit(None).cast("string"), F.lit("no such file")))) == (None, "NO SUCH FILE")
    assert tuple(one(spark, V.chunk_metadata(F.lit('{"page": 3, "chunk_num": "x"}')))) == ("3", None, None)
    assert tuple(one(spark, V.chunk_metadata(F.lit("no json")))) == (None, None, None)
    assert one(spark, V.cites(F.lit(None).cast("array<string>"))) is False
    with pytest.raises(ValueError):
        V.turned({"a": "x", "b": "x"})


def test_states(spark):
    m = lambda s: F.from_json(F.lit(s), "map<string,int>")
    none = F.lit(None).cast("map<string,int>")
    assert one(spark, V.merged_maps(m('{"a": 1, "b": 2}'), m('{"b": 3}'))) == {"a": 1, "b": 3}
    assert one(spark, V.merged_maps(none, m('{"b": 3}'))) == {"b": 3}
    assert one(spark, V.merged_maps(m('{"b": 3}'), none)) == {"b": 3}
    assert one(spark, V.merged_maps(none, none)) is None
    assert one(spark, V.merged_lists(F.array(F.lit(1)), F.lit(None).cast("array<int>"))) == [1]


def test_sections_by_page(spark):
    cut = lambda text, first, offset, last, pages: [tuple(p) for p in one(spark, V.page_pieces(F.lit(text), F.lit(first), F.lit(offset), F.lit(last), F.array(*map(F.lit, pages))))]
    assert cut("cdefgh", 1, 2, 3, [4, 3, 5]) == [(1, "cd"), (2, "efg"), (3, "h")]
    assert cut("bc", 2, 1, 2, [4, 3, 5]) == [(2, "bc")]
    assert cut("dxyz", 1, 3, 3, [4, 0, 5]) == [(1, "d"), (2, ""), (3, "xyz")]


def test_summaries(spark):
    rows = spark.createDataFrame([("yes", 1.0), ("none found", 2.0)], "a string, s double")
    assert tuple(evaluation.summary(rows, "a", "s", "none").first()) == (2, 1, 50.0, 1.5)
    assert tuple(evaluation.summary(rows.where("false"), "a", "s", "none").first()) == (0, 0, None, None)
    pages = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "id int, pages_len long")
    got = evaluation.lengths_agree(pages, spark.createDataFrame([(1, 10), (2, 9)], "id int, sections_len long"), "id")
    assert {r.id: r.whole for r in got.collect()} == {1: True, 2: False, 3: False}


def test_pieces_of_long_texts_take_one_walk(spark):
    t = "ab\n\r\U0001f600é\x00" * 50
    got = spark.range(1).select(V.pieces(F.lit(t), 33).alias("x"), V.pieces(F.lit(""), 33).alias("none")).first()
    assert got.x == [t[i : i + 33] for i in range(0, len(t), 33)] and got.none == []


def test_sections_of_a_long_text(spark, tmp_path):
    """A text of a megabyte: its sections are cut in proportion to its length (before, in proportion to its square: over a minute)."""
    import time

    rows = [(1, "wörd\n" * 200_000), (2, None), (3, ""), (4, "x" * 700), (5, "y" * 701), (6, "z" * 3501)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = QUERIES["section_pages"](spark, str(tmp_path)).collect()
    took = time.time() - began
    want = []
    for i, t in rows:
        for b in range(0, len(t or ""), 700):
            e = min(b + 700, len(t))
            want += [(i, b // 700, p, t[max(b, (p - 1) * 500) : min(e, p * 500)]) for p in range(b // 500 + 1, (e - 1) // 500 + 2)]
    assert sorted(map(tuple, got)) == sorted(want) and took < 20
    lengths = QUERIES["section_length_check"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.pages_len, r.sections_len, r.whole) for r in lengths} == {i: (len(t), len(t), True) for i, t in rows if t}
