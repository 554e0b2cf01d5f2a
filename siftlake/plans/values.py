"""Queries over answers, error records, states, metadata and summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import values as V
from siftlake.operators import evaluation, languages
from siftlake.plans.registry import load, query, texts
from siftlake.plans.search import C_SQL, D_SQL, chunks, documents
from siftlake.sources import tables


@query("""SELECT p_partkey, trim(CASE p_partkey % 3 WHEN 0 THEN '"''' || p_name || '''' WHEN 1 THEN p_name || '"' ELSE '"it''s ' || p_name || '"' END, '"''') AS answer FROM part""")
def strip_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    said = F.when(kind == 0, F.concat(F.lit("\"'"), name, F.lit("'"))).when(kind == 1, F.concat(name, F.lit('"'))).otherwise(F.concat(F.lit("\"it's "), name, F.lit('"')))
    return load(spark, sf_dir, "part").select("p_partkey", V.unquoted(said).alias("answer"))


@query(f"WITH {C_SQL} SELECT doc_id, chunk_num, CASE WHEN doc_id % 3 > 0 THEN 'p' || chunk_num END AS page, CASE WHEN doc_id % 4 > 0 THEN CAST(chunk_num AS INTEGER) END AS read_num, CAST(length(chunk_text) AS INTEGER) AS read_len FROM ch")
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from JSON metadata: pages absent from a third of the documents, numbers that are none in a quarter."""
    num = F.col("chunk_num").cast("string")
    page = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("p"), num))
    meta = F.to_json(F.struct(page.alias("page"), F.when(F.col("doc_id") % 4 > 0, num).otherwise("none").alias("chunk_num"), F.length("chunk_text").alias("chunk_len_in_chars")))
    rows = chunks(texts(spark, sf_dir)).select("doc_id", "chunk_num", V.chunk_metadata(meta).alias("m"))
    return rows.select("doc_id", "chunk_num", "m.page", F.col("m.chunk_num").alias("read_num"), F.col("m.chunk_len_in_chars").alias("read_len"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'it' THEN 'Italian' END AS language, count(*) AS n FROM documents GROUP BY lang")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", V.looked_up(F.col("lang"), V.LANGUAGES).alias("language"), "n")


BACKENDS = {"BUILDING": "b-1", "MACHINERY": "m-1", "FURNITURE": "f-1"}


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b-1' WHEN 'MACHINERY' THEN 'm-1' WHEN 'FURNITURE' THEN 'f-1' END AS backend,
CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN c_mktsegment END AS back FROM customer""")
def backend_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one catalogue to those of another, and back. Market segments stand for models."""
    there = V.looked_up(F.col("c_mktsegment"), BACKENDS)
    return load(spark, sf_dir, "customer").select("c_custkey", there.alias("backend")).withColumn("back", V.looked_up(F.col("backend"), V.turned(BACKENDS))).select("c_custkey", "backend", "back")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'E_' || (p_partkey % 3) || 'X' END AS code, upper(p_name) AS description FROM part")
def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    record = V.error_record(F.when(kind > 0, F.concat(F.lit("e_"), kind.cast("string"), F.lit("x"))), F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", record.alias("e")).select("p_partkey", "e.code", "e.description")


TOOL = "CASE CAST((conv_id + turn) % 5 AS INTEGER) WHEN 0 THEN 'web_search' WHEN 3 THEN 'enterprise' ELSE 'title' END"


@query(f"SELECT conv_id, bool_or({TOOL} IN ('web_search', 'enterprise', 'attached_documents')) AS needs_citations FROM conversations GROUP BY conv_id")
def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for tasks, each done by one tool."""
    tools = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.expr(TOOL)).alias("tools"))
    return tools.select("conv_id", V.cites(F.col("tools")).alias("needs_citations"))


@query("""WITH a AS (SELECT p_partkey AS id, 'k' || (p_partkey % 3) AS k, p_partkey AS v FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 'x', 1 FROM part WHERE p_partkey % 5 > 0),
b AS (SELECT p_partkey AS id, 'k' || (p_partkey % 2) AS k, -p_partkey AS v FROM part WHERE p_partkey % 7 > 0),
m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND b.k = a.k)),
g AS (SELECT id, string_agg(k || '=' || v, ',' ORDER BY k) AS state FROM m GROUP BY id)
SELECT p_partkey, coalesce(state, '') AS state, CASE WHEN p_partkey % 35 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'old,' || p_name ELSE 'old,' || p_name || ',new' END AS log
FROM part LEFT JOIN g ON id = p_partkey""")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state's map and log with an update; either may be absent."""
    k = F.col("p_partkey").cast("long")
    key = lambda n: F.concat(F.lit("k"), (k % n).cast("string"))
    old, new = F.when(k % 5 > 0, F.create_map(key(3), k, F.lit("x"), F.lit(1).cast("long"))), F.when(k % 7 > 0, F.create_map(key(2), -k))
    was, then = F.when(k % 5 > 0, F.array(F.lit("old"), F.col("p_name"))), F.when(k % 7 > 0, F.array(F.lit("new")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(V.merged_maps(old, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return load(spark, sf_dir, "part").select("p_partkey", F.coalesce(shown, F.lit("")).alias("state"), F.coalesce(F.array_join(V.merged_lists(was, then), ","), F.lit("")).alias("log"))


@query(f"WITH {C_SQL}, {D_SQL} SELECT collection_id, count(DISTINCT name) AS n_docs, count(*) AS n_pages FROM ch JOIN d USING (doc_id) GROUP BY collection_id")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and pages behind each collection's chunks."""
    return evaluation.source_counts(chunks(documents(spark, sf_dir), ("collection_id", "name")), ["collection_id"], "name")


@query(f"WITH {C_SQL} SELECT 'documents' AS name, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches FROM documents UNION ALL SELECT 'chunks', CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM ch")
def migration_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 1000 rows that a migration takes."""
    size = lambda df, name: df.agg(F.ceil(F.count("*") / 1000).alias("batches")).select(F.lit(name).alias("name"), "batches")
    return size(load(spark, sf_dir, "documents"), "documents").union(size(chunks(texts(spark, sf_dir)), "chunks"))


@query("""SELECT count(*) AS n_questions, count(*) FILTER (NOT contains(text, 'not')) AS n_correct, round(100.0 * count(*) FILTER (NOT contains(text, 'not')) / count(*), 6) AS pct_correct, round(avg(turn * 0.5), 6) AS mean_latency
FROM conversations WHERE text IS NOT NULL""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for answers, and half their numbers for seconds."""
    answers = load(spark, sf_dir, "conversations").where("text IS NOT NULL").select("text", (F.col("turn") * 0.5).alias("latency"))
    return evaluation.summary(answers, "text", "latency", "not")


SECTIONS = "s AS (SELECT doc_id, text, b, least(b + 700, length(text)) AS e FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 700)) AS b FROM documents WHERE length(text) > 0))"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages of 500 characters and sections of 700: doc_id, section_no, x (page, piece)."""
    docs = texts(spark, sf_dir).where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.posexplode(V.pieces(F.col("text"), 700)).alias("section_no", "own"))
    b = F.col("section_no") * 700
    cut = docs.select("*", (b % 500).alias("offset"), F.expr("section_no * 700 div 500").cast("int").alias("before"), F.expr("(section_no * 700 + length(own) - 1) div 500").cast("int").alias("last"))
    # Of all pages' lengths a section needs those of its own pages.
    lengths = F.transform(F.sequence("before", "last"), lambda p: F.least(F.lit(500), F.col("n") - p * 500))
    cut = cut.select("doc_id", "section_no", "own", "offset", "before", (F.col("last") - F.col("before") + 1).alias("last"), lengths.alias("lengths"))
    rows = cut.select("doc_id", "section_no", "before", F.explode(V.page_pieces(F.col("own"), F.lit(1), F.col("offset"), F.col("last"), F.col("lengths"))).alias("x"))
    return rows.select("doc_id", "section_no", F.struct((F.col("x.page") + F.col("before")).alias("page"), "x.piece").alias("x"))


@query(f"""WITH {SECTIONS} SELECT doc_id, CAST(b // 700 AS INTEGER) AS section_no, CAST(p AS INTEGER) AS page, substr(text, greatest(b, (p - 1) * 500) + 1, least(e, p * 500) - greatest(b, (p - 1) * 500)) AS piece
FROM s, unnest(range(b // 500 + 1, (e - 1) // 500 + 2)) AS r(p)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "section_no", "x.page", "x.piece")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS pages_len, CAST(length(text) AS BIGINT) AS sections_len, true AS whole FROM documents WHERE length(text) > 0")
def section_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's sections are as long as its pages together."""
    got = sections(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("x.piece")).alias("sections_len"))
    pages = load(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").cast("long").alias("pages_len"))
    return evaluation.lengths_agree(pages, got, "doc_id")


HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def language_profiles(spark: SparkSession, sf_dir: str) -> languages.Profiles:
    """Fitted once on the documents that are not held out."""
    known = load(spark, sf_dir, "documents").where(f"NOT ({HELD_OUT})")
    build = lambda at: languages.saved(languages.fitted(known, "doc_id"), spark, f"{at}/profiles")
    return tables.opened(spark, "languages", sf_dir, build, lambda s, at: languages.opened(s, f"{at}/profiles"))


CRC = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT)"""


@query(f"SELECT lang, count(*) AS n, true AS whole_texts, true AS five_words FROM documents WHERE xor({CRC}, 4294967295::BIGINT) % 4 = 2 AND text <> '' GROUP BY lang")
def language_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, over all held-out documents: are 95 % of the whole texts found right, and 80 % of their first five words?"""
    docs = load(spark, sf_dir, "documents").where(f"{HELD_OUT} AND text <> ''").select("doc_id", "text", "lang")
    model = language_profiles(spark, sf_dir)
    words = F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 5), " ")
    both = docs.select("lang", F.lit(1).alias("whole"), "text").unionAll(docs.select("lang", F.lit(0), words))
    right = languages.detected(both, model).withColumn("right", (F.col("language") == F.col("lang")).cast("int"))
    share = lambda whole: F.avg(F.when(F.col("whole") == whole, F.col("right")))
    return right.groupBy("lang").agg(F.sum("whole").alias("n"), (share(1) >= 0.95).alias("whole_texts"), (share(0) >= 0.8).alias("five_words"))
