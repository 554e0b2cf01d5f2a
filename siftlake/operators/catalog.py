"""Collections and documents: create, find, rename, delete; and moves between layouts. All return new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: File endings by what reads them.
READERS = {"pdf": ("pdf",), "slides": ("ppt", "pptx"), "sheet": ("xlsx", "xls", "csv"), "html": ("htm", "html")}
COLUMNS = "collection_id int, doc_id long, lang string, summary string, name string, format string, meta string"


def reader_of(ending):
    """Name of the reader of a file ending; null for endings that nothing reads."""
    out = F.lit(None).cast("string")
    for name, endings in READERS.items():
        out = F.when(F.lower(ending).isin(*endings), F.lit(name)).otherwise(out)
    return out


def resolved(rows: DataFrame, collections: DataFrame, tenant: int) -> DataFrame:
    """Rows of a tenant's collection; an unknown tenant is an error."""
    found = collections.where(F.col("tenant_id") == tenant).orderBy("collection_id").select("collection_id").first()
    if found is None:
        raise LookupError("collection not found")
    return rows.where(F.col("collection_id") == found[0])


def get_or_create(collections: DataFrame, tenants: DataFrame) -> DataFrame:
    """Collections with one more for each tenant without one, numbered on in the tenants' order."""
    last = collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("last"))
    new = tenants.select("tenant_id").distinct().join(collections, "tenant_id", "left_anti")
    number = F.row_number().over(Window.orderBy("tenant_id"))
    return collections.unionByName(new.crossJoin(F.broadcast(last)).select((F.col("last") + number).cast("int").alias("collection_id"), "tenant_id"))


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (documents or their chunks) without those of the deleted documents; always by both keys."""
    return rows.join(gone.select("collection_id", "doc_id"), ["collection_id", "doc_id"], "left_anti")


def renamed(docs: DataFrame, collection: int, doc_id: int, old: str, new: str) -> DataFrame:
    hit = (F.col("collection_id") == collection) & (F.col("doc_id") == doc_id) & (F.col("name") == old)
    return docs.withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name")))


def existing(asked: DataFrame, docs: DataFrame) -> DataFrame:
    return asked.join(docs.select("collection_id", "doc_id"), ["collection_id", "doc_id"], "left_semi")


def missing(asked: DataFrame, docs: DataFrame) -> DataFrame:
    return asked.join(docs.select("collection_id", "doc_id"), ["collection_id", "doc_id"], "left_anti")


def overflow(df: DataFrame, known: list[str], to: str = "meta") -> DataFrame:
    """Columns outside of the known ones packed as JSON."""
    extra = [c for c in df.columns if c not in known]
    return df.select(*[c for c in df.columns if c in known], F.to_json(F.struct(*extra)).alias(to)) if extra else df.withColumn(to, F.lit("{}"))


def backfilled(chunks: DataFrame, doc: str, order: str, column: str) -> DataFrame:
    """Each document's first value in an explicit order; a partial aggregate."""
    return chunks.groupBy(doc).agg(F.min_by(column, order).alias(column))
