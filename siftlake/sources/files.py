"""Reading files into pages, and writing documents, chunks and postings.

Formats that need a library which is not here (PDF, slides, spreadsheets, OCR) are read by extractors that callers register; each
is a function of (bytes) -> list of page texts, run in an Arrow batch on the executors.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.catalog import reader_of

Extractor = Callable[[bytes], list[str]]
EXTRACTORS: dict[str, Extractor] = {}
#: An extractor raises this for files without text, which the retry step sends to the next parser.
SCANNED = "scanned"


class Scanned(Exception):
    """All pages are empty: the file holds pictures."""


def register(reader: str, extractor: Extractor) -> None:
    EXTRACTORS[reader] = extractor


def _plain(data: bytes) -> list[str]:
    return [data.decode("utf-8", "replace")]


def _csv(data: bytes) -> list[str]:
    """One page: the rows as CSV text under a header, each with its number in the file first."""
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if r]
    out = io.StringIO()
    levels, names = header_of(rows[:10], max(map(len, rows), default=0))
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["", *names])
    w.writerows([i, *r] for i, r in enumerate(rows) if i not in levels)
    return [out.getvalue()]


def header_of(rows: list[list[str]], width: int) -> tuple[list[int], list[str]]:
    """The rows that are header levels, and the columns' names: the rule of chunking.header_rows. A level's empty cells take the name to their left;
    where a column is still without one, the columns are numbered."""
    seen: set[int] = set()
    levels = []
    for i, r in enumerate(rows):
        own = {j for j, c in enumerate(r) if c.strip()}
        if not i or own - seen:
            levels.append(i)
        seen |= own
    names: list[list[str]] = [[] for _ in range(width)]
    for i in levels:
        last = ""
        for j in range(width):
            last = rows[i][j].strip() if j < len(rows[i]) and rows[i][j].strip() else last
            names[j].append(last)
    whole = levels and all(x for n in names for x in n)
    return levels, [" ".join(n) for n in names] if whole else [str(j) for j in range(width)]


EXTRACTORS |= {"text": _plain, "sheet": _csv}


def local_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, ending, content, length of files by any path that Spark reads."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return spark.read.format("binaryFile").load(pattern).select("path", ending.alias("ending"), "content", "length")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"local": local_files}


def load_with(loader: str, spark: SparkSession, pattern: str) -> DataFrame:
    if loader not in LOADERS:
        raise ValueError(f"unknown loader {loader}")
    return LOADERS[loader](spark, pattern)


def pages(files: DataFrame) -> DataFrame:
    """path, status, page (a string, from 1) and text: NUL characters go; unreadable files have one row with their status."""
    named = files.withColumn("reader", F.coalesce(F.when(F.col("ending").isin("txt", "md"), "text"), reader_of(F.col("ending"))))
    known = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, reader, data in zip(*(b.column(c).to_pylist() for c in ("path", "reader", "content"))):
                if reader == "html":
                    rows.append((path, "html", "1", data.decode("utf-8", "replace")))
                elif reader not in known:
                    rows.append((path, "unsupported", None, None))
                else:
                    try:
                        texts = known[reader](data)
                        if not any(t.strip() for t in texts):
                            raise Scanned
                        rows += [(path, "done", str(i + 1), t.replace("\x00", "")) for i, t in enumerate(texts)]
                    except Scanned:
                        rows.append((path, SCANNED, None, None))
                    except Exception as e:  # a bad file must not stop the others
                        rows.append((path, f"failed: {type(e).__name__}", None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["path", "status", "page", "text"])

    from siftlake.operators.web import markdown

    read = named.select("path", "reader", "content").mapInArrow(run, "path string, status string, page string, text string")
    html = F.col("status") == "html"
    return read.withColumns({"text": F.when(html, markdown(F.translate("text", "\x00", ""))).otherwise(F.col("text")), "status": F.when(html, F.lit("done")).otherwise(F.col("status"))})


def first_tokens(text: Column, ending: Column, n: int) -> Column:
    """The start of a document for metadata extraction: parts between commas for spreadsheets, between blanks otherwise."""
    by = lambda sep: F.array_join(F.slice(F.split(text, sep), 1, n), sep)
    return F.when(ending == "xlsx", by(",")).otherwise(by(" "))


#: The properties of a file that are kept.
PROPERTIES = ("author", "creator", "producer", "subject", "title", "pages")


def properties(df: DataFrame, struct: Column) -> DataFrame:
    """File properties, each null if it is not there."""
    return df.withColumn("properties", F.struct(*[F.try_element_at(struct, F.lit(n)).alias(n) for n in PROPERTIES]))


def store(documents: DataFrame, chunks: DataFrame, postings: DataFrame, root: str) -> None:
    """Appends the three tables, partitioned by collection, so that a tenant's query reads its own files only."""
    for name, df in (("documents", documents), ("chunks", chunks), ("postings", postings)):
        df.write.partitionBy("collection_id").mode("append").parquet(f"{root}/{name}")
