"""The queries over these operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.quality_rules import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, features=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM f
"""


def op9_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, digested, and whether their pieces decode to the whole text."""
    import public_tokenizers

    from siftlake.llm.sampling import digest, sample_segmentations

    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")
    return digest(sample_segmentations(docs, model, k=2, alpha=1e-3, seed=1, verify=True))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.quality_model import classify

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, pct=80)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
                          ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, md5(CAST(list_sort(sh) AS VARCHAR)) AS k, sh FROM s),
c AS (SELECT k, min(doc_id) AS rep, any_value(n_shingles) AS m FROM n WHERE n_shingles > 0 GROUP BY k),
x AS (SELECT c.rep, c.m, unnest(n.sh) AS g FROM c JOIN n ON n.doc_id = c.rep),
e AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.m, b.m) >= 80 * greatest(a.m, b.m)
      GROUP BY a.rep, b.rep, a.m, b.m HAVING 100 * count(*) >= 80 * (a.m + b.m - count(*))),
r(u, v) AS (SELECT rep, rep FROM c UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
t AS (SELECT u, min(v) AS comp FROM r GROUP BY u)
SELECT n.doc_id, n.n_shingles, coalesce(t.comp, n.doc_id) AS component_id, n.doc_id = coalesce(t.comp, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.k = c.k AND n.n_shingles > 0 LEFT JOIN t ON t.u = c.rep
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftlake.llm.packing import digest, pack

    docs, tokenizer = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    return digest(pack(docs, tokenizer, length=2048, end_id=1))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.licences import licences_found

    return licences_found(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80)


def _op3_sql() -> str:
    from siftlake.llm.licences import BLOCKS, TEMPLATES

    values = ", ".join(f"('{k}', '{t}')" for k, t in TEMPLATES.items())
    wide = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in BLOCKS.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH v(licence, t) AS (VALUES {values}),
tp AS (SELECT licence, {grams} AS b FROM (SELECT licence, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM v)),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
lb AS (SELECT doc_id, line_no, {grams} AS b FROM (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM ls) WHERE len(w) BETWEEN 2 AND 40),
x AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, licence, CAST(len(list_intersect(lb.b, tp.b)) AS BIGINT) AS n_common, CAST(len(lb.b) AS BIGINT) AS n_line, CAST(len(tp.b) AS BIGINT) AS n_template FROM lb, tp),
bv(licence, t) AS (VALUES {wide}),
bt AS (SELECT licence, {grams} AS b, len(w) AS words FROM (SELECT licence, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM bv)),
dw AS (SELECT id, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
ah AS (SELECT d.id, t.licence FROM (SELECT id, unnest(g) AS gram FROM dw) d JOIN (SELECT licence, unnest(b) AS gram, len(b) AS m FROM bt) t USING (gram) GROUP BY d.id, t.licence, t.m HAVING count(DISTINCT gram) * 120 >= t.m * 80),
pl AS (SELECT id, doc_id, g, bt.licence, bt.b AS tb, bt.words, unnest(range(0, greatest(len(g) + 1 - bt.words, 0) + 1)) AS word_no FROM ah JOIN dw USING (id) JOIN bt USING (licence)),
wi AS (SELECT id, doc_id, licence, word_no, tb, list_distinct(g[word_no + 1:word_no + words - 1]) AS wb FROM pl),
bx AS (SELECT id, doc_id, licence, CAST(word_no AS INTEGER) AS place, CAST(len(list_intersect(wb, tb)) AS BIGINT) AS n_common, CAST(len(wb) AS BIGINT) AS n_piece, CAST(len(tb) AS BIGINT) AS n_template FROM wi),
bb AS (SELECT *, row_number() OVER (PARTITION BY id, licence ORDER BY round(2.0::DOUBLE * n_common / (n_piece + n_template), 6) DESC, place) AS nth FROM bx WHERE n_common * 200 >= (n_piece + n_template) * 80)
SELECT doc_id, 'line' AS kind, line_no AS place, licence, n_common, n_line AS n_piece, n_template, round(2.0::DOUBLE * n_common / (n_line + n_template), 6) AS dice FROM x WHERE n_common * 200 >= (n_line + n_template) * 80
UNION ALL SELECT doc_id, 'block', place, licence, n_common, n_piece, n_template, round(2.0::DOUBLE * n_common / (n_piece + n_template), 6) FROM bb WHERE nth = 1
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftlake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key of the caller", items="n_items")


#: The rules of the contract.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url's last number is the id of the document behind it, which `labels` may mark as bad (quality 0 or toxic)."""
    from siftlake.llm.url_filter import host_and_path, judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    number = F.regexp_extract(host_and_path(F.col("url"))[1], "/([0-9]{1,18})(?:[.]html)?/?$", 1)
    labelled = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return judge_urls(pages, labelled, URL_RULES)


OP7_SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
d AS (SELECT *, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
        lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '<n>' WHEN regexp_matches(s, '^[0-9]+[.][A-Za-z0-9]+$') THEN '<n>' || regexp_extract(s, '[.][A-Za-z0-9]+$')
                       WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}$') THEN '<x>' ELSE s END), '/') AS shape,
        TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[.]html)?/?$', 1), '') AS BIGINT) AS num FROM b),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
s AS (SELECT host, shape, count(*) AS c, CAST(count(l.bad) AS DOUBLE) AS n, CAST(coalesce(sum(l.bad), 0) AS DOUBLE) AS bad, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS parts
      FROM d LEFT JOIN l ON d.num = l.doc_id GROUP BY host, shape),
st AS (SELECT host, shape, c, i AS pos, parts[i + 1] AS seg, coalesce(array_to_string(parts[1:i], '/'), '') AS parent FROM s, unnest(range(0, len(parts))) AS r(i)),
wd AS (SELECT host, parent, seg FROM (SELECT host, parent, seg, sum(c) AS c, count(*) OVER w AS k, sum(sum(c)) OVER w AS tot FROM st GROUP BY host, parent, seg WINDOW w AS (PARTITION BY host, parent)) WHERE k > 50 AND c * 50 <= tot),
tm AS (SELECT st.host, st.shape, list(CASE WHEN wd.host IS NULL THEN st.seg ELSE '*' END ORDER BY pos) AS t FROM st LEFT JOIN wd ON st.host = wd.host AND st.parent = wd.parent AND st.seg = wd.seg GROUP BY st.host, st.shape),
nm AS (SELECT s.host, s.shape, s.n, s.bad, coalesce(tm.t, []) AS t FROM s LEFT JOIN tm ON s.host = tm.host AND s.shape = tm.shape),
px AS (SELECT host, coalesce(array_to_string(t, '/'), '') AS template, n, bad, i AS depth, coalesce(array_to_string(t[1:i], '/'), '') AS node, coalesce(array_to_string(t[1:greatest(i - 1, 0)], '/'), '') AS parent
       FROM nm, unnest(range(0, len(t) + 1)) AS r(i)),
nd AS (SELECT host, depth, node, parent, sum(n) AS n, sum(bad) AS bad FROM px GROUP BY ALL),
g1 AS (SELECT *, bad / n AS r FROM nd WHERE n > 0),
kd AS (SELECT host, depth, list({'gs': [{'n': n, 'bad': bad, 'nodes': [node]}]} ORDER BY r, node) AS l FROM g1 GROUP BY host, depth, parent),
fd AS (SELECT host, depth, unnest(list_reduce(l, lambda a, x: CASE WHEN abs(x.gs[1].bad / x.gs[1].n - a.gs[-1].bad / a.gs[-1].n)
         > 1.96 * sqrt((x.gs[1].bad + a.gs[-1].bad) / (x.gs[1].n + a.gs[-1].n) * (1 - (x.gs[1].bad + a.gs[-1].bad) / (x.gs[1].n + a.gs[-1].n)) * (1 / x.gs[1].n + 1 / a.gs[-1].n))
       THEN {'gs': list_concat(a.gs, x.gs)}
       ELSE {'gs': list_append(a.gs[1:len(a.gs) - 1], {'n': a.gs[-1].n + x.gs[1].n, 'bad': a.gs[-1].bad + x.gs[1].bad, 'nodes': list_concat(a.gs[-1].nodes, x.gs[1].nodes)})} END).gs) AS g FROM kd),
ow AS (SELECT host, depth, unnest(g.nodes) AS node, g.n, g.bad FROM fd UNION ALL SELECT host, depth, node, n, bad FROM nd WHERE n = 0),
pr AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM nd WHERE depth = 0),
ju AS (SELECT q.host, q.template, list_reduce(list({'n': ow.n, 'bad': ow.bad} ORDER BY q.depth), lambda a, x: {'n': 0.0::DOUBLE, 'bad': (x.bad + 4 * a.bad) / (x.n + 4)}, {'n': 0.0::DOUBLE, 'bad': (SELECT p FROM pr)}).bad > 0.5 AS reject
       FROM (SELECT DISTINCT host, template, depth, node FROM px) q JOIN ow ON q.host = ow.host AND q.depth = ow.depth AND q.node = ow.node GROUP BY q.host, q.template),
ru AS (SELECT page_id, host, path, shape, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM d)
SELECT page_id, ru.host, ru.path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN ju.reject THEN 'block' ELSE 'allow' END AS verdict
FROM ru JOIN nm ON ru.host = nm.host AND ru.shape = nm.shape JOIN ju ON ju.host = nm.host AND ju.template = coalesce(array_to_string(nm.t, '/'), '')
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents").select("text", "lang"), least=30, top=2000, covered=80)


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
x AS (SELECT lang, w1, lead(w1, 1) OVER v AS w2, lead(w1, 2) OVER v AS w3, lead(w1, 3) OVER v AS w4 FROM w WINDOW v AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS m, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
o AS MATERIALIZED (SELECT * FROM f WHERE a >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM o WHERE m > 1),
k AS (SELECT c.lang, c.phrase, c.a, r.k, array_to_string(ws[1:r.k], ' ') AS lp, array_to_string(ws[r.k + 1:], ' ') AS rp FROM c, unnest(range(1, c.m)) AS r(k)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * k.a) // (x.a + y.a) AS BIGINT) AS score FROM k JOIN o x ON x.lang = k.lang AND x.phrase = k.lp JOIN o y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(ws[i:i + d - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest([2, 3]) AS q(d), unnest(range(1, 4)) AS r(i) WHERE d < m AND i + d - 1 <= m GROUP BY ALL),
z AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 7 divides are presented with one more character than they have: their proofs must fail."""
    from siftlake.llm.merkle import digest, folded, leaf_of, manifest

    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    presented = F.when(changed, leaf_of(*[more if c == "n_chars" else F.col(c) for c in fields]))
    out = manifest(docs, fields, group="lang", key="doc_id", carry={"presented": presented})
    root = folded(F.coalesce("presented", "leaf"), F.col("proof")).alias("folded_root")
    return out.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), root).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT) AS crc FROM documents),
lf AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS presented FROM f),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM lf),
up(lv, g, place, total, h) AS (SELECT 0, g, place, total, leaf FROM pl UNION ALL SELECT lv + 1, g, place // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE total > 1 GROUP BY lv, g, place // 2, (total + 1) // 2),
sr AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM up WHERE total = 1),
top(lv, place, total, h) AS (SELECT 0, place, total, h FROM sr UNION ALL SELECT lv + 1, place // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE total > 1 GROUP BY lv, place // 2, (total + 1) // 2),
wy AS (SELECT pl.g, pl.place, r.lv, (pl.place >> r.lv) & 1 AS odd, u.h AS sib FROM pl JOIN (SELECT g, max(lv) AS d FROM up GROUP BY g) m USING (g), unnest(range(0, m.d)) AS r(lv)
       LEFT JOIN up u ON u.g = pl.g AND u.lv = r.lv AND u.place = xor(pl.place >> r.lv, 1)
       UNION ALL SELECT pl.g, pl.place, 1000 + r.lv, (sr.place >> r.lv) & 1, t.h FROM pl JOIN sr USING (g), unnest(range(0, (SELECT max(lv) FROM top))) AS r(lv)
       LEFT JOIN top t ON t.lv = r.lv AND t.place = xor(sr.place >> r.lv, 1)),
pf AS (SELECT g, place, list({'odd': odd, 's': coalesce(sib, '')} ORDER BY lv) AS p FROM wy GROUP BY g, place),
o AS (SELECT pl.doc_id, pl.leaf, sr.h AS subroot, (SELECT h FROM top WHERE total = 1) AS root, coalesce(pf.p, []) AS p, coalesce(presented, leaf) AS a FROM pl JOIN sr USING (g) LEFT JOIN pf ON pf.g = pl.g AND pf.place = pl.place),
x AS (SELECT *, sha256(coalesce(array_to_string(list_transform(p, lambda z: z.s), ''), '')) AS proof_sha256,
        list_reduce(p, lambda c, z: {'odd': 0::BIGINT, 's': sha256(CASE WHEN z.odd = 1 THEN z.s || c.s ELSE c.s || z.s END)}, {'odd': 0::BIGINT, 's': a}).s AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM x
"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftlake.llm.best_fit import digest, pack

    docs, tokenizer = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    return digest(pack(docs, tokenizer, length=2048, end_id=0))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_packing, op3_license_scan, op4_token_counts, op5_exact_topk, op6_pii_pseudonyms, op7_url_filter, op8_quality_rules, op9_sampled_segmentations, op10_quality_classifier, op11_phrase_collocations, op12_merkle_manifest, op13_best_fit_packing)}
ORACLES = {"op1_minhash_near_dedup": OP1_SQL, "op3_license_scan": _op3_sql(), "op5_exact_topk": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_phrase_collocations": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
