"""Queries over scalars, chats, ledgers, catalogues, task plans and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import values as V
from siftlake.operators import catalog, chat, evaluation, merging, tasks
from siftlake.plans.registry import load, query, texts
from siftlake.plans.search import C_SQL, D_SQL, best_chunks, chunks, documents, scored_sql
from siftlake.streaming import ingest


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+\z', '', 'g'), '[^\x20-\x7E\n\r\t]', '', 'g'), 'Page \d+ of \d+|HEADER_PATTERN|FOOTER_PATTERN', chr(10), 'g') AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", T.squeezed(t).alias("squeezed"), T.cleaned(t).alias("cleaned"))


@query(r"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[^\x20-\x7E\n\r\t]', '', 'g')) AS INTEGER) AS n_removed FROM documents")
def mask_nonprintable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", (F.length(t) - F.length(T.printable(t))).alias("n_removed"))


CITED = "'see [AIMessage: ' || turn || '] [aimessage: ' || turn || ', and more] and [Excerpt: ' || (turn + 1) || ', ' || (conv_id % 7) || '] [Excerpt: ' || (turn + 1) || ']'"


@query(f"""WITH x AS (SELECT conv_id, turn, {CITED} AS t FROM conversations), y AS (SELECT *, regexp_replace(t, '(?i)\\[AI.+?:\\s*(\\d+.*?)\\]', '', 'g') AS u FROM x)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(u, '\\[.*?:(.*?\\d+)\\]', 1), lambda g: regexp_extract_all(g, '\\d+'))), lambda n: CAST(n AS BIGINT)))), ',') AS cited,
 regexp_replace(t, '\\[.+?:\\s*(\\d+.*?)\\]', '', 'g') AS plain FROM y""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation tags are put behind each turn; the ids they cite, and the text without them."""
    t = F.format_string("see [AIMessage: %d] [aimessage: %d, and more] and [Excerpt: %d, %d] [Excerpt: %d]", "turn", "turn", F.col("turn") + 1, F.col("conv_id") % 7, F.col("turn") + 1)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.cited_ids(t)).cast("array<string>"), ",").alias("cited"), T.without_citations(t).alias("plain"))


@query(f"""WITH {D_SQL}, s AS (SELECT doc_id, name, regexp_replace(name, '\\.[A-Za-z]{{3,5}}$', '') AS stem FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat([name, stem], regexp_extract_all(stem, '[A-Za-z0-9]+')), list_concat(regexp_extract_all(stem, '[A-Za-z]+'), regexp_extract_all(stem, '[0-9]+'))))), ' ') AS tokens FROM s""")
def filename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.filename_tokens(F.col("name")), " ").alias("tokens"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(f"""WITH {D_SQL} SELECT doc_id, summary || chr(10) || source || chr(10) || text AS embed_input FROM d""")
def embed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", "summary", "source", "text").alias("embed_input"))


@query(f"""WITH {D_SQL} SELECT doc_id, summary || ' ' || chr(10) || name || ' ' || chr(10) || 'Unknown' || ' ' || chr(10) || text AS rerank_input FROM d""")
def rerank_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.coalesce(F.lit(None).cast("string"), F.lit("Unknown"))
    return documents(spark, sf_dir).select("doc_id", F.concat_ws(" \n", "summary", "name", author, "text").alias("rerank_input"))


@query("""SELECT doc_id, CASE WHEN n > 0 AND TRY_CAST(p AS INTEGER) IS NOT NULL THEN p || ' - ' || (TRY_CAST(p AS INTEGER) + n) ELSE p END AS label
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cover' ELSE CAST(doc_id AS VARCHAR) END AS p, CAST(doc_id % 3 AS INTEGER) AS n FROM documents)""")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("doc_id") % 5 == 0, "cover").otherwise(F.col("doc_id").cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", T.page_label(p, (F.col("doc_id") % 3).cast("int")).alias("label"))


@query(f"""WITH {D_SQL} SELECT collection_id, count(*) AS n, CASE WHEN count(*) <= 20 THEN array_to_string(list(summary ORDER BY doc_id), chr(10) || chr(9) || '- ') ELSE '' END AS context FROM d GROUP BY collection_id""")
def summary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a collection's files, if they are 20 at most: others are counted, not gathered."""
    d = documents(spark, sf_dir)
    few = d.groupBy("collection_id").agg(F.count("*").alias("n"))
    some = d.join(few.where("n <= 20").select("collection_id"), "collection_id", "left_semi")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "summary"))), lambda x: x["summary"])
    text = some.groupBy("collection_id").agg(F.array_join(parts, "\n\t- ").alias("context"))
    return few.join(text, "collection_id", "left").select("collection_id", "n", F.coalesce("context", F.lit("")).alias("context"))


@query(f"WITH {D_SQL} SELECT DISTINCT name, doc_id AS id, 'txt' AS format, 'txt' AS original_format, lang, source FROM d")
def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("name", F.col("doc_id").alias("id"), F.lit("txt").alias("format"), F.lit("txt").alias("original_format"), "lang", "source").distinct()


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Not Provided') AS designation, coalesce(c_name, 'Not Provided') AS name FROM customer")
def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = lambda c: F.coalesce(c, F.lit("Not Provided"))
    return load(spark, sf_dir, "customer").select("c_custkey", given(F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("designation"), given(F.col("c_name")).alias("name"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'text' END AS t, CASE WHEN p_partkey % 20 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 1 THEN p_size || '.5' ELSE p_brand END AS v FROM part)
SELECT p_partkey, CASE WHEN t = 'int' THEN TRY_CAST(v AS BIGINT) END AS int_value, CASE WHEN t = 'float' THEN TRY_CAST(v AS DOUBLE) END AS float_value, CASE WHEN t = 'text' THEN v END AS text_value FROM x""")
def typed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read by their declared types: what does not fit its type is null, an unknown type is an error. Here a part's size or brand, declared by its number."""
    key = F.col("p_partkey")
    kinds = F.when(key % 3 == 0, "int").when(key % 3 == 1, "float").otherwise("text")
    given = F.when(key % 20 == 0, F.col("p_type")).when(key % 3 == 0, F.col("p_size").cast("string")).when(key % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", *V.typed(given, kinds))


ENDING = "CASE CAST(doc_id % 6 AS INTEGER) WHEN 0 THEN 'pdf' WHEN 1 THEN 'pptx' WHEN 2 THEN 'XLSX' WHEN 3 THEN 'csv' WHEN 4 THEN 'html' ELSE 'exe' END"


@query(f"SELECT reader, count(*) AS n FROM (SELECT CASE lower({ENDING}) WHEN 'pdf' THEN 'pdf' WHEN 'pptx' THEN 'slides' WHEN 'xlsx' THEN 'sheet' WHEN 'csv' THEN 'sheet' WHEN 'html' THEN 'html' END AS reader FROM documents) GROUP BY reader")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(catalog.reader_of(F.expr(ENDING)).alias("reader")).groupBy("reader").agg(F.count("*").alias("n"))


@query(f"WITH {D_SQL} SELECT doc_id, name FROM d WHERE collection_id = 7")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection n belongs to tenant 100 + n."""
    d = documents(spark, sf_dir)
    owners = d.select("collection_id").distinct().withColumn("tenant_id", F.col("collection_id") + 100)
    return catalog.resolved(d, owners, 107).select("doc_id", "name")


@query(f"WITH {D_SQL} SELECT collection_id, doc_id FROM d WHERE doc_id % 10 <> 3")
def doc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("collection_id", "doc_id")
    return catalog.without_documents(d, d.where("doc_id % 10 = 3"))


@query(f"WITH {D_SQL} SELECT doc_id, CASE WHEN doc_id = 5 THEN 'renamed.txt' ELSE name END AS name FROM d")
def doc_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.renamed(documents(spark, sf_dir), 5, 5, "src5_5.txt", "renamed.txt").select("doc_id", "name")


@query(f"WITH {D_SQL} SELECT doc_id, true AS there FROM d UNION ALL SELECT doc_id + 1000000000, false FROM d")
def doc_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("collection_id", "doc_id")
    asked = d.union(d.select("collection_id", F.col("doc_id") + 1_000_000_000))
    return catalog.existing(asked, d).select("doc_id", F.lit(True).alias("there")).union(catalog.missing(asked, d).select("doc_id", F.lit(False)))


@query(f"WITH {D_SQL}, c AS (SELECT DISTINCT collection_id, collection_id + 100 AS tenant_id FROM d), n AS (SELECT t AS tenant_id FROM (VALUES (100), (500), (501)) v(t) WHERE t NOT IN (SELECT tenant_id FROM c)) SELECT * FROM c UNION ALL SELECT CAST((SELECT max(collection_id) FROM c) + row_number() OVER (ORDER BY tenant_id) AS INTEGER), tenant_id FROM n")
def collection_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = documents(spark, sf_dir).select("collection_id").distinct().withColumn("tenant_id", F.col("collection_id") + 100)
    return catalog.get_or_create(owners, spark.createDataFrame([(100,), (500,), (501,)], "tenant_id int"))


@query(f"WITH {D_SQL} SELECT collection_id, min_by(name, doc_id) AS name FROM d GROUP BY collection_id")
def backfill_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.backfilled(documents(spark, sf_dir), "collection_id", "doc_id", "name")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, question, text AS answer FROM p WHERE role = 'assistant' AND pr = 'user') SELECT conv_id, array_to_string(list('Question: ' || question || ' ' || chr(10) || ' Answer: ' || answer ORDER BY turn), chr(10)) AS history FROM q GROUP BY conv_id""")
def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.as_text(chat.pairs(load(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pair, CAST(ceil(length(question) / 4.0) + ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM p WHERE role = 'assistant' AND pr = 'user'),
r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pair DESC) AS BIGINT) AS running FROM q) SELECT conv_id, pair, tokens, running, 76565 AS document_budget, 45939 AS history_budget FROM r WHERE running <= 300""")
def chat_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.pairs(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    tokens = T.token_estimate(F.col("question")) + T.token_estimate(F.col("answer"))
    documents_, history = merging.budgets(F.lit(128000), F.lit(100), answer=4096)
    return chat.within_budget(pairs, "conv_id", tokens, 300).select("conv_id", "pair", "tokens", "running", documents_.alias("document_budget"), history.alias("history_budget"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations), t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM k WHERE b <= 6 AND role IN ('user', 'assistant') AND text <> '')
SELECT conv_id, turn, '[' || CASE role WHEN 'user' THEN 'HumanMessage' ELSE 'AIMessage' END || ': ' || n || ']' || text AS line FROM t""")
def chat_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.tagged(chat.last_turns(load(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "line")


@query("SELECT user_id AS model, round(sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END), 2) AS prompt_tokens, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 2) AS completion_tokens, count(*) AS n_calls FROM events GROUP BY user_id")
def token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda on: F.when(on, F.col("value")).otherwise(0.0)
    seen = F.col("event_type") == "view"
    return chat.ledger(load(spark, sf_dir, "events").withColumnRenamed("user_id", "model"), "model", side(~seen), side(seen))


@query("SELECT event_id, user_id, event_type, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6) - (epoch_us(ts) / 1e6), 3) AS seconds FROM events")
def latency_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.latencies(load(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "event_type", "seconds")


@query("""WITH u AS (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS words, count(*) AS credits FROM events GROUP BY user_id), l AS (SELECT *, 400000 AS word_limit, 230 AS credit_limit FROM u)
SELECT user_id, words, credits, NOT (words > word_limit OR credits > credit_limit) AS allowed, CASE WHEN credits > credit_limit THEN 'CREDIT_LIMIT' WHEN words > word_limit THEN 'WORD_LIMIT' END AS code FROM l""")
def quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("words"), F.count("*").alias("credits"))
    return chat.quota(use.withColumns({"word_limit": F.lit(400000), "credit_limit": F.lit(230)})).select("user_id", "words", "credits", "allowed", "code")


GOLD = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {GOLD}, f AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS rank FROM gold JOIN documents USING (doc_id) WHERE lang = 'en'),
b AS (SELECT gold.item_id, min(rank) AS rank FROM gold LEFT JOIN (SELECT * FROM f WHERE rank <= 1) f ON gold.item_id = f.item_id AND gold.doc_id = f.doc_id GROUP BY gold.item_id)
SELECT count(*) AS n_questions, count(rank) AS n_hits, round(100.0::DOUBLE * count(rank) / count(*), 6) AS pct_hits, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM b""")
def eval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: documents that hold a benchmark text. Results: each question's last gold document in English, if it has one."""
    gold = evaluation.contained(load(spark, sf_dir, "benchmark"), texts(spark, sf_dir))
    english = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    found = gold.join(english, "doc_id", "left_semi").groupBy("item_id").agg(F.max("doc_id").alias("doc_id")).withColumn("rank", F.lit(1))
    return evaluation.hit_rate(found, gold)


QW = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(rf"""WITH {C_SQL}, qt AS (SELECT DISTINCT item_id, unnest({QW}) AS lexeme FROM benchmark), {scored_sql('ch').replace('JOIN qt USING (lexeme)', 'WHERE lexeme IN (SELECT lexeme FROM qt)')},
si AS (SELECT item_id, u, sum(tf / (tf + 1) * ln(1 + (n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS s FROM hi JOIN dfq USING (lexeme) JOIN qt USING (lexeme), nn GROUP BY item_id, u),
t AS (SELECT item_id, u, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, u) AS rank FROM si QUALIFY rank <= 3),
qw AS (SELECT item_id, list_distinct({QW}) AS q FROM benchmark),
f AS (SELECT t.item_id, ch.doc_id, ch.page, len(list_intersect(q, regexp_extract_all(lower(chunk_text), '[\p{{L}}\p{{N}}]+'))) / len(q)::DOUBLE AS similarity FROM t JOIN ch ON ch.chunk_id = t.u JOIN qw ON qw.item_id = t.item_id),
gold AS (SELECT item_id, doc_id, length(substr(d.text, 1, instr(d.text, b.text) - 1)) - length(replace(substr(d.text, 1, instr(d.text, b.text) - 1), chr(10), '')) + 1 AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT gold.item_id, max(CASE WHEN abs(gold.page - f.page) <= 1 THEN 1 ELSE 0 END) AS page FROM gold JOIN f ON f.item_id = gold.item_id AND f.doc_id = gold.doc_id GROUP BY gold.item_id),
e AS (SELECT i.item_id, r.item_id IS NOT NULL AS file, r.page, m.best FROM (SELECT DISTINCT item_id FROM gold) i LEFT JOIN r ON r.item_id = i.item_id LEFT JOIN (SELECT item_id, max(similarity) AS best FROM f GROUP BY item_id) m ON m.item_id = i.item_id)
SELECT count(*) AS n_questions, round(100.0::DOUBLE * count(*) FILTER (file) / count(*), 6) AS pct_file, round(100.0::DOUBLE * coalesce(sum(page), 0) / count(*), 6) AS pct_page,
 round(coalesce(sum(page), 0)::DOUBLE / nullif(count(*) FILTER (file), 0), 6) AS con_prob, round(avg(best), 6) AS mean_best FROM e""")
def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks searched with every benchmark text: are its file and page among the three best, and how like is the best one?"""
    questions = load(spark, sf_dir, "benchmark").select("item_id", "text")
    words = F.array_distinct(T.words(F.col("text")))
    terms = questions.select("item_id", F.explode(words).alias("lexeme"))
    best, of = best_chunks(spark, sf_dir, terms, "item_id", 3)
    cut = chunks(of).select("doc_id", "chunk_id", "page", "chunk_text")
    met = best.join(cut, "chunk_id").join(questions.select("item_id", words.alias("q")), "item_id")
    found = met.select("item_id", "doc_id", "page", (F.size(F.array_intersect("q", T.words(F.col("chunk_text")))) / F.size("q")).alias("similarity"))
    return evaluation.retrieval_rates(found, evaluation.first_pages(questions, texts(spark, sf_dir).select("doc_id", "text")))


@query("""WITH x AS (SELECT l.quality, l.toxic, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS hit FROM labels l JOIN documents d USING (doc_id))
SELECT 'quality' AS flag, count(*) AS n, round(100.0::DOUBLE * avg(hit), 6) AS pct FROM x WHERE quality = 1 UNION ALL SELECT 'toxic', count(*), round(100.0::DOUBLE * avg(hit), 6) FROM x WHERE toxic = 1""")
def eval_flag_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("hit", (F.col("n_chars") > 1000).cast("int"))
    return evaluation.flag_shares(rows, "hit", ["quality", "toxic"])


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: each needs those of half and a third of its number, some also that of twice their number (a cycle) or one that is not there."""
    o = F.col("o_orderkey")
    needs = F.array(F.when(o > 0, F.expr("o_orderkey div 2")), F.when(o > 2, F.expr("o_orderkey div 3")), F.when((o > 0) & (o % 997 == 0), o * 2), F.when(o % 50 == 7, o + 1_000_000_000))
    return load(spark, sf_dir, "orders").select(o.alias("task_id"), F.array_compact(needs).alias("depends_on"), "o_orderstatus")


P_SQL = """p AS (SELECT o_orderkey AS task_id, o_orderstatus, list_filter([CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END, CASE WHEN o_orderkey > 2 THEN o_orderkey // 3 END, CASE WHEN o_orderkey > 0 AND o_orderkey % 997 = 0 THEN o_orderkey * 2 END,
 CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey + 1000000000 END], lambda x: x IS NOT NULL) AS needs FROM orders), e AS (SELECT DISTINCT task_id, unnest(needs) AS need FROM p)"""


@query(f"""WITH RECURSIVE {P_SQL}, k AS MATERIALIZED (SELECT e.* FROM e JOIN p ON e.need = p.task_id), c(a, b) AS (SELECT task_id, need FROM k UNION SELECT c.a, k.need FROM c JOIN k ON c.b = k.task_id),
bad AS MATERIALIZED (SELECT a FROM c WHERE a = b UNION SELECT a FROM c WHERE b IN (SELECT a FROM c WHERE a = b)),
w(task_id, level) AS (SELECT task_id, 0 FROM p WHERE task_id NOT IN (SELECT task_id FROM k) UNION SELECT k.task_id, w.level + 1 FROM w JOIN k ON k.need = w.task_id WHERE k.task_id NOT IN (SELECT a FROM bad))
SELECT p.task_id, max(w.level) AS level, p.task_id NOT IN (SELECT need FROM e) AS terminal FROM p LEFT JOIN w USING (task_id) GROUP BY p.task_id""")
def task_dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.levels(plan(spark, sf_dir))


@query(f"WITH {P_SQL}, f AS (SELECT task_id FROM p WHERE o_orderstatus = 'F') SELECT task_id FROM p WHERE o_orderstatus <> 'F' AND task_id NOT IN (SELECT task_id FROM e WHERE need NOT IN (SELECT task_id FROM f))")
def task_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are done."""
    every = plan(spark, sf_dir)
    return tasks.ready(every, every.where("o_orderstatus = 'F'").select("task_id"))


@query(f"WITH {P_SQL} SELECT task_id, need AS needs FROM e WHERE need NOT IN (SELECT task_id FROM p)")
def plan_dangling_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.dangling(plan(spark, sf_dir))


def _folder(spark: SparkSession) -> str:
    """In the cluster's shared folder; on a local master without one, in the temporary folder."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/siftlake-streams/{uuid.uuid4().hex}"


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are skipped if their key was ingested before: one row for each (user, type), by a stream over the events."""
    at = _folder(spark)
    stream = ingest.events_stream(spark, f"{sf_dir}/event[s].parquet", load(spark, sf_dir, "events").schema).select("user_id", "event_type")
    ingest.run_available(ingest.first_ever(stream, ["user_id", "event_type"]), f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
    return spark.read.parquet(f"{at}/out").select("user_id", "event_type")


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def stream_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums for each model as state of a stream; the last complete result is the answer."""
    at = _folder(spark)
    stream = ingest.events_stream(spark, f"{sf_dir}/event[s].parquet", load(spark, sf_dir, "events").schema)
    ingest.run_available(ingest.sums(stream, "user_id", "value"), f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out"), "complete")
    return spark.read.parquet(f"{at}/out")
