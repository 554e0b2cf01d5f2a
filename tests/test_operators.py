"""Golden fixtures and properties of the operators."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import plugins
from siftlake.operators import catalog, chunking, fusion, keyword, merging, tasks, vector
from siftlake.operators.prefix import running
from siftlake.sources import files

LOOSE = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_uniform_splitter(spark):
    got = chunking.uniform_chunks(spark.createDataFrame([(1, ["abcdefghij", "klmno"]), (2, []), (3, [""])], "d int, p array<string>"), "d", "p", 6, 2).orderBy("chunk_num").collect()
    assert [(r.chunk_num, r.start, r.chunk_text, r.page, r.page_breaks) for r in got] == [(1, 0, "abcdef", 1, []), (2, 4, "efghij", 1, []), (3, 8, "ijklmn", 1, [2]), (4, 12, "mno", 2, [])]


def test_uniform_splitter_overshoot(spark):
    got = chunking.uniform_chunks(spark.createDataFrame([(1, ["abcdefghij", "klm"])], "d int, p array<string>"), "d", "p", 6, 3).orderBy("chunk_num").collect()
    assert [r.chunk_text for r in got] == ["abcdef", "defghi", "ghijkl", "jklm", "m"]
    assert [r.page_breaks for r in got][2:4] == [[4], [1]]


@LOOSE
@given(st.lists(st.text("abc", max_size=9), max_size=5), st.integers(2, 7), st.integers(0, 1))
def test_chunks_cover_the_text(spark, pages, size, overlap):
    got = chunking.uniform_chunks(spark.createDataFrame([(1, pages)], "d int, p array<string>"), "d", "p", size, overlap).orderBy("chunk_num").collect()
    text, step = "".join(pages), size - overlap
    assert len(got) == math.ceil(len(text) / step)
    assert "".join(r.chunk_text[:step] for r in got) == text


def plain_table_chunks(files, header, size):
    """Slices that hold both ends, as a data frame's rows are sliced by labels."""
    out, quoted = [], lambda c: "" if c is None else '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c
    for file, tables in sorted(files.items()):
        num = 0
        for table, rows in sorted(tables.items()):
            upto, ends = 0, {}
            for i, r in enumerate(rows):
                upto += sum(3 if c is None else len(c) for c in r)
                ends[math.ceil(upto / size)] = i
            begin = 0
            for end in ends.values():
                num += 1
                text = "".join(",".join(map(quoted, r)) + "\n" for r in [header, *rows[begin : end + 1]])
                out.append((file, table, num, begin, end, end - begin + 1, text))
                begin = end
    return out


@pytest.mark.parametrize("tasks", [1, 6])
def test_table_splitter(spark, tasks):
    rng = random.Random(tasks)
    cell = lambda: rng.choice([None, "", "a,b", 'say "x"', "two\nlines", "plain", "long " * 5, str(rng.random())])
    files = {f: {t: [[cell() for _ in range(3)] for _ in range(n)] for t, n in enumerate(sizes)} for f, sizes in enumerate(([900, 1, 20], [3], [40, 2, 1, 1]))}
    rows = [(f, t, i, r) for f, ts in files.items() for t, rs in ts.items() for i, r in enumerate(rs)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = chunking.table_chunks(spark.createDataFrame(rows, "f int, t int, i int, c array<string>"), "f", "t", "i", "c", ["h", "x,y", "z"], 60).orderBy("f", "chunk_num").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [tuple(r) for r in got] == plain_table_chunks(files, ["h", "x,y", "z"], 60)


def test_running_sums_of_a_hot_group(spark):
    rows = [(None if i % 10 == 0 else "hot", i, i % 7) for i in range(1000)]
    got = running(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], {"upto": "v"})
    own = {}
    for g, i, v in rows:
        own.setdefault(g, []).append(v)
    assert {(r.g, r.place): r.upto for r in got.collect()} == {(g, n): sum(vs[: n + 1]) for g, vs in own.items() for n in range(len(vs))}
    assert running(spark.createDataFrame([], "g string, i int, v int"), ["g"], ["i"]).count() == 0


def lists(spark, semantic, keywords):
    make = lambda xs: spark.createDataFrame([(k, i + 1, 1.0 / (i + 1)) for i, k in enumerate(xs)], "k string, rank int, score double")
    return make(semantic), make(keywords)


def test_reciprocal_rank(spark):
    got = fusion.reciprocal_rank(*lists(spark, "abc", "bd"), "k").orderBy("rank").collect()
    assert [(r.k, round(r.score, 9)) for r in got] == [("b", 0.016261237), ("a", 0.008196721), ("d", 0.008064516), ("c", 0.007936508)]
    got = fusion.reciprocal_rank(*lists(spark, ["10", "20", "30"], ["20", "40"]), "k", 0.3).orderBy("rank").collect()
    assert [(r.k, round(r.score, 9)) for r in got] == [("20", 0.016314120), ("40", 0.011290323), ("10", 0.004918033), ("30", 0.004761905)]


def test_fusion_of_empty_sides(spark):
    a, b = lists(spark, "ab", "")
    for f in (fusion.reciprocal_rank, fusion.rescaled, fusion.simple):
        assert [r.k for r in f(a, b, "k").orderBy("rank").collect()] == ["a", "b"]
        assert f(b, b, "k").count() == 0


def test_scores(spark):
    r = one(spark, *[F.round(keyword.ts_rank(F.lit(n)), 9).alias(f"n{n}") for n in (1, 2, 3)])
    assert tuple(r) == (0.607927102, 0.759908877, 0.827456333)
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0)] + [(i, "a", 9.0) for i in (2,)] + [(i, "b", 9.0) for i in (2, 3, 4, 5)], "c int, lexeme string, tf double")
    s = keyword.bm25(hits, ["c"], spark.createDataFrame([(10,)], "n_all int")).where("c = 1").first().s
    assert round(s, 9) == 0.840441771 and round(s / (s + 1), 9) == 0.456652193
    blend = keyword.blended(spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "d int, c int, s double"), spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "d int, c int, prox double"), ["d", "c"])
    best = keyword.best_per_document(blend, "d", "c").first()
    assert best.c == 1 and round(best.score, 9) == 0.553333333
    assert round(one(spark, keyword.ts_rank_weighted(F.array(F.lit(0.4), F.lit(1.0))).alias("x")).x, 6) == round((0.4 + 0.25 + 0.75) / 1.64493406685, 6)


def test_diversity_and_mmr(spark):
    vs = [[1.0, 0.0], [0.999, 0.0447], [0.0, 1.0], [0.7, 0.7], [0.02, 1.0]]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(vs)], "rank int, k int, v array<double>")
    assert [r["rank"] for r in vector.diverse(df, 0.98).orderBy("rank").collect()] == [0, 2, 3]
    assert vector.diverse(df.where("false"), 0.98).count() == 0
    got = vector.maximal_marginal_relevance(df.select("k", F.col("v").alias("embedding")), [1.0, 0.0], 3, 5, "k", weight=0.3).orderBy("pick").collect()
    assert got[0].k == 0 and len({r.k for r in got}) == 3 and got[1].k == 2


def test_softmax(spark):
    got = spark.createDataFrame([(0.9,), (0.8,), (0.1,)], "s double").select(F.round(fusion.softmax(F.col("s")), 9).alias("p")).collect()
    assert sorted((r.p for r in got), reverse=True) == [0.424778812, 0.384355764, 0.190865424]


def test_overlap(spark):
    cases = [("abcdef", "efgh", "ef"), ("abc", "abc", ""), ("aaa", "aaab", "aa"), ("xyz", "q", ""), ("", "a", ""), ("a", "a", ""), ("x" + "ab" * 40, "ab" * 30 + "c", "ab" * 30), ("zz" + "a" * 30, "a" * 40, "a" * 30), (r"q\E.(x)[1]\Qabcdefgh", r"\E.(x)[1]\Qabcdefgh and on", r"\E.(x)[1]\Qabcdefgh"), ("über 日本語の文章はここで終わる", "文章はここで終わるが次が続く", "文章はここで終わる"), ("the end of a", "a longer next text", "a")]
    got = spark.createDataFrame(cases, "a string, b string, o string").select("o", T.overlap(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.o == r.x for r in got)


def test_runs(spark):
    rows = [(k, n) for k, ns in enumerate(([1, 3, 4], [1, 2, 5], [1, 5, 6, 10])) for n in ns]
    got = merging.runs(spark.createDataFrame(rows, "d int, n int"), "d", "n").groupBy("d").agg(F.countDistinct("run").alias("r")).orderBy("d").collect()
    assert [r.r for r in got] == [1, 1, 3]


def test_merge_fills_gaps(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(200))
    cut = chunking.uniform_chunks(spark.createDataFrame([(1, [text])], "d int, p array<string>"), "d", "p", 20, 6)
    near = chunking.with_neighbours(cut, ["d"], "chunk_num", "chunk_text").where("chunk_num IN (1, 2, 4, 7)")
    got = merging.merged_runs(near, "d").first()
    assert text.startswith(got.text) and (got.first, got.last) == (1, 7) and len(got.text) == 6 * 14 + 20


def test_budgets_and_text(spark):
    ranked = spark.createDataFrame([(i + 1, t) for i, t in enumerate((100, 60, 50, 40))], "rank int, t int")
    assert merging.token_prefix(ranked, "t", 210).count() == 3
    d, h = merging.budgets(F.lit(128000), F.lit(100), 4096)
    assert tuple(one(spark, d.alias("d"), h.alias("h"))) == (76565, 45939)
    assert one(spark, T.truncated_query(F.lit("one two three")).alias("q")).q == "one two three one two three"
    assert [one(spark, T.stream_buffer(F.lit(n)).alias("b")).b for n in (1, 2, 5, 20)] == [1, 4, 9, 15]
    assert sorted(one(spark, T.cited_ids(F.lit("see [AIMessage: 9] and [Excerpt: 2, 3] [Excerpt: 7]")).alias("c")).c) == [2, 3, 7]
    assert sorted(one(spark, T.cited_ids(F.lit("[aimessage: 3] [AIMessage: 4, and more] [AI turn: 5 or 6] [Excerpt: 7]")).alias("c")).c) == [7]
    assert one(spark, T.verdict(F.lit("it is right. Y")).alias("v")).v == 1
    assert [tuple(x) for x in one(spark, T.task_citations(F.lit("[Task: 1, 2, Excerpt: 3]")).alias("x")).x] == [(1, 3), (2, 3)]
    key = F.lit(b"k" * 32)
    assert one(spark, T.decrypted(T.encrypted(F.lit("secret"), key), key).alias("x")).x == "secret"


def test_vector_search_matches_brute_force(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    q = vector.query_vector(e, "vec_id", 3)
    cos = lambda v: 1 - sum(a * b for a, b in zip(q, v)) / math.sqrt(sum(a * a for a in q) * sum(b * b for b in v))
    want = [i for _, i in sorted((round(cos(v), 9), i) for i, v in rows)[:10]]
    assert [r.vec_id for r in vector.nearest(e, q, 10, "vec_id").orderBy("rank").collect()] == want


def test_unknown_tenant(spark):
    owners = spark.createDataFrame([(1, 101)], "collection_id int, tenant_id int")
    rows = spark.createDataFrame([(1, 5)], "collection_id int, doc_id int")
    assert catalog.resolved(rows, owners, 101).count() == 1
    with pytest.raises(LookupError):
        catalog.resolved(rows, owners, 999)


def test_file_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\x00 world")
    (tmp_path / "b.csv").write_text("Year,,Sum\n,name,\n2020,x,1\n2021,y,2\n")
    (tmp_path / "c.html").write_text("<html><body><h1>T</h1><p>a &amp; b</p></body></html>")
    (tmp_path / "d.exe").write_bytes(b"\x01")
    (tmp_path / "e.txt").write_text(" ")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.pages(files.load_with("local", spark, f"file://{tmp_path}/*")).collect()}
    assert got["a.txt"].text == "hello world" and got["a.txt"].page == "1"
    assert got["b.csv"].text.splitlines() == [",0,1,2", "2,2020,x,1", "3,2021,y,2"]  # no row of data is lost; the second level has no name for the first column
    assert files.header_of([["A", "", "B"], ["x", "y", "z"], ["1", "2", "3"]], 3) == ([0, 1], ["A x", "A y", "B z"])
    assert files.header_of([["a", "b"], ["1", "2"]], 2) == ([0], ["a", "b"]) and files.header_of([], 0) == ([], [])
    assert got["c.html"].text.strip() == "# T\na & b"
    assert got["d.exe"].status == "unsupported" and got["e.txt"].status == "scanned"
    with pytest.raises(ValueError):
        files.load_with("other", spark, "x")


def test_plugins(spark):
    r = one(spark, plugins.HashEmbedder(8)(F.lit("a b b")).alias("v"), plugins.overlap_reranker(F.lit("a b"), F.lit("b c")).alias("o"), plugins.detected_language(F.lit("der die und das")).alias("l"), plugins.routed(F.lit("x"), {"a": "b"}, "d").alias("t"))
    assert abs(sum(x * x for x in r.v) - 1) < 1e-9 and r.o == 0.5 and r.l == "de" and r.t == "d"
    got = plugins.refined(spark.createDataFrame([("a b c d",)], "text string"), lambda t: T.first_words(t, 2), lambda s: F.lit(3.0)).first()
    assert got.summary == "a b" and got.revision == 2


def test_page_breaks_through_trimming_merging_and_pages(spark):
    rng = random.Random(3)
    pages = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (13, 5, 31, 2, 40, 9, 50)]
    text, ends, at = "".join(pages), [], 0
    for p in pages:
        at += len(p)
        ends.append(at)
    cut = chunking.uniform_chunks(spark.createDataFrame([(1, pages)], "d int, p array<string>"), "d", "p", 20, 6)
    near = chunking.with_neighbours(cut, ["d"], "chunk_num", "chunk_text")
    for r in merging.trimmed_neighbours(near).collect():
        assert text[r.start - len(r.previous) : r.start + r.chunk_len + len(r.next)] == r.previous + r.chunk_text + r.next
        assert [r.start - len(r.previous) + b for b in r.previous_breaks] == [e for e in ends if r.start - len(r.previous) < e < r.start]
        stop = r.start + r.chunk_len
        assert [stop + b for b in r.next_breaks] == [e for e in ends if stop < e < stop + len(r.next)]
    got = merging.merged_runs(near.where("chunk_num IN (1, 2, 4, 7)"), "d").first()
    assert text.startswith(got.text) and got.page == 1 and got.page_breaks == [e for e in ends if e < len(got.text)]
    whole = merging.in_context(merging.trimmed_neighbours(merging.merged_runs(near.where("chunk_num IN (2, 3)"), "d"), "text"), "text")
    pieces = merging.by_page(whole, ["d"], "text", "page", "page_breaks").orderBy("page").collect()
    assert "".join(r.piece for r in pieces) == text[: 5 * 14 + 6][: len("".join(r.piece for r in pieces))]
    assert all(p.piece in pages[p.page - 1] or len(pieces) == 1 for p in pieces) and [p.page for p in pieces] == list(range(1, len(pieces) + 1))


def test_neighbour_gates(spark):
    rows = spark.createDataFrame([(1, 1, "a", "H", "pdf"), (1, 2, "b", "H", "pdf"), (1, 3, "c", "K", "pdf"), (2, 1, "d", None, "csv"), (2, 2, "e", None, "csv")], "d int, n int, t string, h string, f string")
    got = {r.t: (r.previous, r.next) for r in chunking.with_neighbours(rows, ["d"], "n", "t", heading="h", alone=F.col("f").isin("csv", "xlsx", "xls")).collect()}
    assert got == {"a": ("", "b"), "b": ("a", ""), "c": ("", ""), "d": ("", ""), "e": ("", "")}


def test_context_of_documents(spark):
    rows = spark.createDataFrame([(7, 2, 1, "x", "H", "n7", None, "s7"), (7, 2, 2, "y", "", "n7", None, "s7"), (3, 1, 5, "z", None, "n3", "me", "s3")], "d int, r int, c int, t string, h string, n string, a string, s string")
    numbered = merging.excerpts(rows, "r", ["c"])
    got = merging.formatted_context(numbered, "d", "r", "t", name="n", authors="a", description="s", heading="h")
    text = merging.whole_context(got, "r").first().context
    assert text == (
        "<Document Start>\nDocument name: n3\nDocument authors: me\nDocument description: s3\n\n[Excerpt: 1]\nz\n<Document End>"
        "<Document Start>\nDocument name: n7\nDocument authors: None\nDocument description: s7\n\n[Excerpt: 2]\nExcerpt heading: H\nx\n\n[Excerpt: 3]\ny\n<Document End>"
    )
    assert merging.whole_context(got.where("false"), "r").first().context == "NO RELEVANT DOCUMENTS FOUND"
    assert [(r.d, r.citation) for r in merging.sources(numbered, ["d"]).orderBy("citation").collect()] == [(3, "1"), (7, "2"), (7, "3")]


@pytest.mark.parametrize("falling", [False, True])
def test_numbers_of_many_rows(spark, falling):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.5, 0.5, 0.5, rng.random()])) for i in range(3000)]
    got = {r.k: r.n for r in merging.numbered(spark.createDataFrame(rows, "k long, s double"), "s", "k", "n", falling=falling).collect()}
    order = sorted(rows, key=lambda r: ((-r[1] if falling else r[1]), r[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(order)}
    assert merging.numbered(spark.createDataFrame([], "k long, s double"), "s", "k", "n").count() == 0


def plain_levels(needs):
    """Longest ways; none on cycles and behind them."""
    needs = {t: {n for n in ns if n in needs} for t, ns in needs.items()}
    level = {}
    while new := [t for t, ns in needs.items() if t not in level and ns <= level.keys()]:
        level |= {t: 1 + max((level[n] for n in needs[t]), default=-1) for t in new}
    return {t: (level.get(t), all(t not in ns for ns in needs.values())) for t in needs}


def test_levels_of_task_graphs(spark):
    rng = random.Random(9)
    graph = {i: {rng.randrange(i) for _ in range(rng.randint(0, 2))} | {rng.randrange(3)} - {i} if i else set() for i in range(200)}
    graph |= {i: {i - 1} if i > 300 else set() for i in range(300, 306)} | {1000: {1001}, 1001: {1000}, 1002: {1001}, 1003: {77777}, 1004: {1004}, 1005: {1002, 5}}
    df = spark.createDataFrame([(t, sorted(ns)) for t, ns in graph.items()] + [(5, [2]), (1003, None)], "task_id int, depends_on array<int>")
    graph[5] |= {2}
    assert {r.task_id: (r.level, r.terminal) for r in tasks.levels(df).collect()} == plain_levels(graph)
    assert {r.task_id for r in tasks.cycles(df).collect()} == {1000, 1001, 1002, 1004, 1005}
    two = df.withColumn("p", F.lit("x")).unionAll(spark.createDataFrame([(1000, [], "y"), (7, [1000], "y")], "task_id int, depends_on array<int>, p string"))
    got = {(r.p, r.task_id): r.level for r in tasks.levels(two, "p").where("task_id IN (7, 1000)").collect()}
    assert got[("y", 1000)] == 0 and got[("y", 7)] == 1 and got[("x", 1000)] is None
    assert tasks.levels(df.where("false")).count() == 0


def test_highlight_takes_terms_as_they_are(spark):
    df = spark.createDataFrame([("a C++ (x) cost $5",)], "t string")
    assert df.select(keyword.highlight(F.col("t"), ["c++", "(x)"], "$<", ">\\").alias("x")).first().x == "a $<C++>\\ $<(x)>\\ cost $5"


def test_cleaning_only_takes_the_marks(spark):
    t = "  My header and footer. Page 1 of 10 HEADER_PATTERN page 2 of 3 Footers \n"
    assert one(spark, T.cleaned(F.lit(t)).alias("x")).x == "My header and footer. \n \n page 2 of 3 Footers"


def test_language_of_a_question(spark):
    ask = lambda q, p, raw=None: one(spark, plugins.query_language(F.lit(q), F.lit(p).cast("string"), None if raw is None else F.lit(raw)).alias("l")).l
    assert ask("what is the sense of that", None) == "en" and ask("und das", "[AIMessage: 3]der die das ist nicht\nthe of and") == "de"
    assert ask("la casa che non per gli una", None) == "it" and ask("los que en una por las", None, "the of and to") == "en"
    with pytest.raises(Exception, match="unsupported language"):
        ask("le les des est une dans", None)


def test_rounds_of_levels_write_what_they_touch(spark, monkeypatch):
    """A binary tree and a chain behind it: the rounds' states hold a few rows for each task (before: a row for each waiting task in each round)."""
    from pyspark.sql import DataFrame, DataFrameWriter

    n, sizes, parquet = 256, [], DataFrameWriter.parquet
    rows = [(i, [i // 2] if i else []) for i in range(n)] + [(i, [i - 1, 0]) for i in range(n, n + 6)] + [(900, [901]), (901, [900]), (902, [900, 1]), (5, [2, 2, 12345])]

    def counted(self, path, *a, **k):
        parquet(self, path, *a, **k)
        if "/state/" in path:
            sizes.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    got = {r.task_id: (r.level, r.terminal) for r in tasks.levels(spark.createDataFrame(rows, "task_id long, depends_on array<long>")).collect()}
    graph = {}
    for t, x in rows:
        graph[t] = sorted({*graph.get(t, []), *x})
    assert got == plain_levels(graph) and got[902] == (None, True)
    assert sum(sizes) < 2 * len(graph) and len(sizes) > 9


def test_header_levels_leave_the_row_as_levels(spark, tmp_path):
    """Of ten lines with many words only the rows that are levels are shuffled (before: a row for each word); ids may repeat."""
    import duckdb

    from siftlake.plans import ORACLES, QUERIES

    wide = "\n".join(["a b", "c", "", "d e f", "g h i", "j " * 4000, "k"] + ["l " * 5000] * 5)
    rows = [(1, wide), (2, None), (3, ""), (4, "one"), (5, "a b\nc"), (5, "x\ny z w"), (5, "a b"), (None, "p q\nr s t"), (6, "\n\n\n\n\n\n\n\n\n\na b c")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLES["header_levels"])
    df = QUERIES["header_levels"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # words are counted, not exploded


def test_header_rows_of_cells_and_of_counts_agree(spark):
    counts = {1: [2, 1, 3, 3, 0, 7], 2: [0, 0, 1], 3: [], 4: [0]}
    cells = spark.createDataFrame([(t, i + 1, c) for t, ns in counts.items() for i, n in enumerate(ns) for c in range(n)], "t int, row int, c int")
    filled = spark.createDataFrame(list(counts.items()), "t int, n array<int>")
    shown = lambda df: {(r.t, r.row, r.filled) for r in df.collect()}
    assert shown(chunking.header_rows_filled(filled, "t", F.col("n"))) == shown(chunking.header_rows(cells, "t", "row", "c")) != set()
