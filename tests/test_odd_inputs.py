"""Inputs on which queries once differed from their SQL."""

from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import chunking, merging


def test_upper_letters_stay_one_letter(spark):
    letters = ["ß", "ä", "a", "1", "ﬁ", "ᾳ", "é", ""]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.upper_letter(F.col("c")).alias("u")).collect()
    assert {r.c: r.u for r in got} == {"ß": "ẞ", "ä": "Ä", "a": "A", "1": "1", "ﬁ": "ﬁ", "ᾳ": "ᾼ", "é": "É", "": ""}


def test_edges_of_words_are_those_of_ascii_letters(spark):
    cases = {"ödie ": True, "die": True, "dieß": True, "a_die": False, "diet": False, "soda die": True}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", F.col("c").rlike(f"{T.EDGE}(?:the|die){T.EDGE}").alias("x")).collect()
    assert {r.c: r.x for r in got} == cases


def test_neighbours_of_repeated_keys(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 1, "c"), ("u", 2, "d"), ("v", 1, "e")], "url string, n int, t string")
    got = sorted((r.url, r.n, r.t, r.previous, r.next) for r in chunking.all_neighbours(rows, ["url"], "n", "t").collect())
    assert got == [("u", 1, "a", "", "b"), ("u", 1, "a", "", "d"), ("u", 1, "c", "", "b"), ("u", 1, "c", "", "d"), ("u", 2, "b", "a", ""), ("u", 2, "b", "c", ""), ("u", 2, "d", "a", ""), ("u", 2, "d", "c", ""), ("v", 1, "e", "", "")]


def test_runs_of_texts_that_repeat_themselves(spark):
    """A period of 3 characters, and page breaks at the ends of chunks."""
    text = "abc" * 40 + "xyz"
    for ends in ([20, 50, 60], [26, 43], [10, 20, 30, 40]):
        pages = [text[a:z] for a, z in zip([0, *ends], [*ends, len(text)])]
        cut = chunking.uniform_chunks(spark.createDataFrame([(1, pages)], "d int, pages array<string>"), "d", "pages", 20, 3)
        near = chunking.with_neighbours(cut, ["d"], "chunk_num", "chunk_text")
        got = merging.merged_runs(near.where("chunk_num IN (1, 2, 4, 7)"), "d").first()
        assert (got.first, got["last"]) == (1, 7) and got.text == text[: 6 * 17 + 20] and got.page_breaks == [e for e in ends if e < len(got.text)]
