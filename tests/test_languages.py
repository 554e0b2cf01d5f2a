"""Languages by runs of characters: held-out accuracy, short texts, odd texts."""

import numpy as np
from pyspark.sql import functions as F

from siftlake.operators import languages

HELD = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def test_held_out_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = languages.fitted(docs.where(f"NOT ({HELD})"), "doc_id")
    assert model.langs == sorted(r.lang for r in docs.select("lang").distinct().collect())
    got = languages.detected(docs.where(HELD), model)
    right = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    short = languages.detected(docs.where(HELD).withColumn("text", F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 5), " ")).where(F.length("text") > 10), model)
    few = short.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95 and few >= 0.8


def test_runs_against_a_plain_count():
    texts = ["Ab  c\n", "", None, "ü", "x" * 50]
    run, text = languages.runs_of(texts)
    want = []
    for i, t in enumerate(texts):
        if t:
            b = " ".join(f" {t} ".lower().split(" ")).replace("\n", " ")
            while "  " in b:
                b = b.replace("  ", " ")
            raw = b.encode()
            for n in languages.RUNS:
                for j in range(len(raw) - n + 1):
                    h = 2166136261 * n % (1 << 32)
                    for c in raw[j : j + n]:
                        h = ((h ^ c) * 16777619) % (1 << 32)
                    want.append((i, (h ^ (h >> 15)) % languages.BUCKETS))
    assert sorted(zip(text.tolist(), run.tolist())) == sorted(want)


def test_odd_texts(spark, tmp_path):
    rows = [(1, "the house and the tree", "en"), (2, "das haus und der baum", "de"), (3, None, "de"), (4, "", "en"), (5, "und der " * 30000, None), (6, "the and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fitted(docs, "doc_id")
    got = {r.doc_id: r.language for r in languages.detected(docs, model, default="xx").collect()}
    assert got == {1: "en", 2: "de", 3: "xx", 4: "xx", 5: "de", 6: "en"}
    languages.saved(model, spark, f"file://{tmp_path}/p")
    again = languages.opened(spark, f"file://{tmp_path}/p")
    assert again.langs == model.langs and np.allclose(again.weights, model.weights)
    none = languages.fitted(docs.where("false"), "doc_id")
    assert {r.language for r in languages.detected(docs, none).collect()} == {None} and languages.detected(docs.where("false"), model).count() == 0
    one = languages.fitted(docs.where("lang = 'en'"), "doc_id")
    assert languages.detected(docs, one).where("doc_id = 2").first().language == "en"
