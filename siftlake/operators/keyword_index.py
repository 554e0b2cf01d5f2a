"""Stored postings with classes, and a top-k that leaves out what cannot reach it.

A unit (document or chunk) has lexemes in two classes, A before B. The index is a table with a row for each lexeme and range of units: the units of the
range that hold the lexeme with their counts by class, how many they are, and the highest damped frequency among them. Rows are partitioned by a hash of the lexeme and
sorted within it, so that a search reads the row groups of its own lexemes only; a lexeme that every unit holds is spread over the ranges' rows.

Top-k: from the rows' heads alone (no units) each range gets a bound, the sum of its best damped frequencies times the lexemes' weights. The FIRST ranges of the
highest bounds are scored; the k-th best score there is a floor, and of all other ranges only those whose bound reaches it are read. The result is that of scoring all.

Units without lexemes are counted but found by nothing; a query without known lexemes finds nothing; equal scores are ordered by key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.operators import keyword

#: Partitions of the index; units of a range; ranges that give the floor.
BUCKETS, RANGE, FIRST = 64, 1024, 8


def class_rank(n_a: Column, n_b: Column) -> Column:
    """Damped frequency of a lexeme with n_a occurrences of class A and then n_b of class B. The highest weight comes first, so that no other place adds to it."""
    weight = lambda j: F.when(j <= n_a, keyword.WEIGHTS["A"]).otherwise(keyword.WEIGHTS["B"])
    return F.aggregate(F.sequence(F.lit(1), (n_a + n_b).cast("int")), F.lit(0.0), lambda s, j: s + weight(j) / (j * j).cast("double")) / keyword.BASEL


def _bucket(lexeme: Column) -> Column:
    return (F.crc32(lexeme) % BUCKETS).cast("int")


def _weight(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("lexeme")) if weights else F.lit(0.0)


@dataclass
class PostingsIndex:
    """An index that was built before. Its table's files are listed once."""

    spark: SparkSession
    root: str
    key: str
    n_all: int

    @cached_property
    def postings(self) -> DataFrame:
        """lexeme, range, units, best, n and bucket."""
        schema = "lexeme string, range long, units array<struct<key: long, n_a: long, n_b: long>>, best double, n long, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/postings")

    def rows(self, lexemes: list[str]) -> DataFrame:
        """The lexemes' rows: partitions and row groups of others are not read."""
        buckets = sorted({zlib.crc32(x.encode()) % BUCKETS for x in lexemes})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(lexemes))

    def weights(self, lexemes: list[str]) -> dict[str, float]:
        """The inverse document frequency of those that are known: a number for each lexeme of a query."""
        df = self.rows(lexemes).groupBy("lexeme").agg(F.sum("n").alias("df"))
        return {r.lexeme: r.idf for r in df.select("lexeme", keyword.idf(F.lit(self.n_all), F.col("df")).alias("idf")).collect()}

    def hits(self, rows: DataFrame) -> DataFrame:
        """key, lexeme, n_a, n_b and tf of rows of the index."""
        each = rows.select("lexeme", F.explode("units").alias("u")).select(F.col("u.key").alias(self.key), "lexeme", "u.n_a", "u.n_b")
        return each.withColumn("tf", class_rank(F.col("n_a"), F.col("n_b")))

    def scores(self, weights: dict[str, float], rows: DataFrame | None = None) -> DataFrame:
        """key, s (summed tf / (tf + 1) * idf) and r (summed weights of all occurrences) of all units, or of some rows of the index."""
        found = self.hits(self.rows(list(weights)) if rows is None else rows)
        each = keyword.WEIGHTS["A"] * F.col("n_a") + keyword.WEIGHTS["B"] * F.col("n_b")
        return found.groupBy(self.key).agg(F.sum(keyword.squashed(F.col("tf")) * _weight(weights)).alias("s"), F.sum(each).alias("r"))

    def all_scores(self, lexemes: list[str]) -> DataFrame:
        return self.scores(self.weights(lexemes))

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """range and bound: no unit of the range scores more. Reads no units."""
        heads = self.rows(list(weights)).select("lexeme", "range", "best")
        return heads.groupBy("range").agg((F.sum(keyword.squashed(F.col("best")) * _weight(weights)) + 1e-9).alias("bound"))

    def floor(self, weights: dict[str, float], k: int) -> tuple[float, bool]:
        """A score that k units reach at least, and whether there are other ranges than those that were tried for it."""
        first = [r[0] for r in self.bounds(weights).orderBy(F.desc("bound"), "range").limit(FIRST + 1).collect()]
        best = self.scores(weights, self.rows(list(weights)).where(F.col("range").isin(first[:FIRST]))).select("s").orderBy(F.desc("s")).limit(k).collect()
        return (best[-1].s if len(best) == k else 0.0), len(first) > FIRST

    def top(self, lexemes: list[str], k: int) -> DataFrame:
        """key, s, r and rank of the k units of the highest s."""
        weights = self.weights(lexemes)
        floor, more = self.floor(weights, k)
        rows = self.rows(list(weights))
        if more:
            rows = rows.join(self.bounds(weights).where(F.col("bound") >= floor).select("range"), "range", "left_semi")
        return keyword.top(self.scores(weights, rows), "s", self.key, k)

    def top_many(self, terms: DataFrame, item: str, k: int) -> DataFrame:
        """item, key, s and rank of the k best units of each of many queries (item, lexeme; each lexeme once): one pass over the postings, an equi-join with the queries' lexemes.

        A task keeps k units of an item before they are shuffled by item.
        """
        own = terms.select("lexeme").distinct()
        rows = self.postings.join(own, "lexeme", "left_semi")
        idf = rows.groupBy("lexeme").agg(keyword.idf(F.lit(self.n_all), F.sum("n")).alias("idf"))
        found = self.hits(rows).join(idf, "lexeme").join(terms.select(item, "lexeme"), "lexeme")
        scored = found.groupBy(item, self.key).agg(F.sum(keyword.squashed(F.col("tf")) * F.col("idf")).alias("s"))
        w = Window.partitionBy(item).orderBy(F.desc(F.round("s", 9)), self.key)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def write_hits(units: DataFrame, key: str, fields: dict[str, Column], lexemes: list[str], path: str) -> None:
    """A row for each unit with the lexemes it holds of those given and their counts by class, counted where the row is: of other words nothing leaves it. key and fields as for `build`."""
    held = units.select(F.col(key).cast("long").alias(key), *[F.filter(v, lambda w: w.isin(lexemes)).alias(f"_{c}") for c, v in fields.items()])
    n = lambda c, w: F.size(F.filter(f"_{c}", lambda x: x == w)).cast("long") if c in fields else F.lit(0).cast("long")
    each = F.transform(F.array_distinct(F.concat(*[f"_{c}" for c in fields])), lambda w: F.struct(w.alias("lexeme"), n("A", w).alias("n_a"), n("B", w).alias("n_b")))
    held.select(key, each.alias("hits")).write.mode("overwrite").parquet(path)


@dataclass
class QuestionHits:
    """The scores of a `PostingsIndex` for one question that is asked before there is an index: from the hits that one pass over the texts wrote (`write_hits`).

    A pass takes a fraction of the time of an index, and what it writes grows with the hits, not with the words. Rows of one key are one unit in the scores.
    """

    spark: SparkSession
    path: str
    key: str

    @cached_property
    def units(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} long, hits array<struct<lexeme: string, n_a: long, n_b: long>>").parquet(self.path)

    def all_scores(self) -> DataFrame:
        """key, s and r of all units that hold a lexeme, as `PostingsIndex.scores` gives them."""
        each = self.units.select(self.key, F.explode("hits").alias("x")).groupBy(self.key, "x.lexeme").agg(F.sum("x.n_a").alias("n_a"), F.sum("x.n_b").alias("n_b"))
        df = each.groupBy("lexeme").agg(F.count("*").alias("df"))
        idf = df.select("lexeme", keyword.idf(F.lit(self.units.count()), F.col("df")).alias("idf"))
        part = keyword.squashed(class_rank(F.col("n_a"), F.col("n_b"))) * F.col("idf")
        weight = keyword.WEIGHTS["A"] * F.col("n_a") + keyword.WEIGHTS["B"] * F.col("n_b")
        return each.join(F.broadcast(idf), "lexeme").groupBy(self.key).agg(F.sum(part).alias("s"), F.sum(weight).alias("r"))

    def top(self, k: int) -> DataFrame:
        return keyword.top(self.all_scores(), "s", self.key, k)


def build(units: DataFrame, key: str, fields: dict[str, Column], root: str) -> PostingsIndex:
    """Writes the index below root. key: whole numbers, one for each unit; fields: class ("A", "B") to an array of lexemes."""
    spark = units.sparkSession
    n, low, high = units.agg(F.count("*"), F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) * RANGE // max(1, n)))
    units = units.withColumn(key, F.col(key).cast("long"))
    each = keyword.postings(units, key, fields, unique=True).withColumn("range", F.floor((F.col(key) - (low or 0)) / width))
    unit = F.struct(F.col(key).alias("key"), "n_a", "n_b")
    best = F.max(class_rank(F.col("n_a"), F.col("n_b")))
    rows = each.groupBy("lexeme", "range").agg(F.array_sort(F.collect_list(unit)).alias("units"), best.alias("best"), F.count("*").alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("bucket", _bucket(F.col("lexeme"))).repartitionByRange(tasks, "bucket", "lexeme", "range").sortWithinPartitions("bucket", "lexeme", "range")
    dealt.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{root}/postings")
    spark.createDataFrame([(key, n)], "key string, n_all long").write.mode("overwrite").parquet(f"{root}/meta")
    return PostingsIndex(spark, root, key, n)


def open_index(spark: SparkSession, root: str) -> PostingsIndex:
    r = spark.read.parquet(f"{root}/meta").first()
    return PostingsIndex(spark, root, r.key, r.n_all)
