"""A corpus pipeline: quality rules, quality classifier, near-dedup, personal data, packing.

Each stage's result is written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
Every call has its own scratch tables in the shared folder: results read them lazily, and two runs do not touch each other. They stay
until the caller drops them (`dropping` in siftlake.llm.common, or with the shared folder).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import minhash, packing, pii, quality_model, quality_rules
from siftlake.llm.common import Scratch, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    Null and empty texts fail the length rule; a very long text is judged whole; repeated rows are each judged; an empty table stays
    empty. The caller's columns stay as they are, whatever they are named.
    """
    return quality_rules.passing(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of quality. The class prior is that of the documents which are still there.

    Null and empty texts are scored like others; without labels every score is 0.5, and nothing stays; repeated rows are scored alike; null ids
    are scored but not learnt from; an empty table stays empty; other columns are kept and not read.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_model.good_rows(docs, quality_model.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near copies (five-word shingles, similarity 0.8). Ids may repeat: rows are told apart by a written number.

    Rows without words are copies of nothing and all stay; null ids come last in a group, and of equal ids the row that was read first stays; an empty table stays empty;
    other columns are kept, whatever they are named.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row_no")), "rows")
    found = minhash.near_duplicates(rows.select("row_no", F.col("doc.text").alias("text")), words=5, pct=80, id_col="row_no", scratch=scratch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("first")
    ids = rows.select("row_no", F.col("doc.doc_id").alias("doc_id"))
    kept = found.select("row_no", "component_id").join(ids, "row_no").groupBy("component_id").agg(first)
    return rows.join(kept.select("first.row_no"), "row_no", "left_semi").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by pseudonyms; n_chars, where it is there, counts the new text.

    Null text stays null and has n_chars null; empty texts, repeated rows, null ids and an empty table stay; other columns are kept, whatever they are named.
    """
    out = pii.pseudonymised(docs, "a key of the caller")
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit little-endian).

    Null and empty texts are one piece that holds the end id; very long ones span sequences; repeated rows are packed each; an empty table gives no
    pieces; other columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1, scratch=Scratch(spark))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-dedup", near_dedup), ("personal data", personal_data), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = between.keep(stage(spark, docs, sf_dir), f"stage_{i}")
        if i > 0:
            between.drop(f"stage_{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
