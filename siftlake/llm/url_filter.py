"""URL filter: stated rules, then a tree of path templates for each host. DataFrame functions only.

Rules name a host (with its subdomains) and a start of the path; the longest one that fits decides. Other urls
are judged by their template:

* A path's segments are generalised where they vary: numbers, numbers with an ending, long hexadecimal ids, and the rare
  children (at most 1 / `max_children` of the pages each) of a node with more than `max_children` different ones become wildcards.
* The templates' prefixes are the nodes of the host's tree. Each node counts labelled pages and bad ones.
* Sibling branches that are like each other are merged: in the order of their shares of bad pages, a branch joins the group before it if its share differs from that of all the group's pages
  together by at most `z` standard errors (of two proportions, pooled), so that no row of small steps leads from good branches to bad ones. A group shares one count. Their
  subtrees are judged by it on the way down. Branches without labelled pages are merged with none.
* A template's badness is smoothed along its path from the root, each node being shrunk towards the one above it by
  `strength` pseudo-pages; the root is shrunk towards the corpus. Templates that are more likely bad than
  `max_bad` are blocked.

Every count is a groupBy with map-side sums, so a host with a third of all pages is no hot key; the children of one node, at most some 2 * `max_children`, are folded in one row; the last join reads one row for
each generalised path, and adaptive execution splits a path that holds many pages.

Ties: of rules of one length the later text in order wins; branches of equal share are ordered by name; a badness of exactly max_bad is allowed; very long urls are one row's work. Defined cases: null or scheme-less urls have an empty host and path; they share one template. Null page ids and
repeated rows are judged each; unlabelled corpora have badness 1/2, which is not over max_bad, so all is allowed;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch

Rules = tuple[tuple[str, str], ...]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (verdict, host/path) each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one is asked before
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def generalised(path: Column) -> Column:
    """The path's segments with those that vary by their form replaced."""

    def one(s: Column) -> Column:
        return (
            F.when(s.rlike("^[0-9]+$"), F.lit("<n>"))
            .when(s.rlike("^[0-9]+[.][A-Za-z0-9]+$"), F.concat(F.lit("<n>"), F.regexp_extract(s, "[.][A-Za-z0-9]+$", 0)))
            .when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("<x>"))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def _grouped(done: Column, x: Column, z: float) -> Column:
    """The groups so far (n, bad, nodes) with one more branch (rate, node, n, bad): in the last group, or in one of its own."""
    last, own = F.element_at(done, -1), F.array(x["node"])
    both = (last["bad"] + x["bad"]) / (last["n"] + x["n"])
    apart = F.abs(x["rate"] - last["bad"] / last["n"]) > z * F.sqrt(both * (1 - both) * (1 / x["n"] + 1 / last["n"]))
    alone = F.struct(x["n"].alias("n"), x["bad"].alias("bad"), own.alias("nodes"))
    pooled = F.struct((last["n"] + x["n"]).alias("n"), (last["bad"] + x["bad"]).alias("bad"), F.concat(last["nodes"], own).alias("nodes"))
    return F.when(F.size(done) == 0, F.array(alone)).when(apart, F.concat(done, F.array(alone))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pooled)))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Rules, *, max_children: int = 50, z: float = 1.96, strength: float = 4.0, max_bad: float = 0.5, url: str = "url", id_col: str = "page_id", scratch: Scratch | None = None) -> DataFrame:
    """id_col, host, path, rule, verdict for every page. labelled: url, bad (0 or 1)."""
    scratch = scratch or Scratch(pages.sparkSession)

    def parsed(df: DataFrame, *keep: Column) -> DataFrame:
        host, path = host_and_path(F.col(url))
        df = df.select(*keep, host.alias("host"), path.alias("path"))
        return df.withColumn("shape", F.array_join(generalised(F.col("path")), "/"))

    all_pages = parsed(pages, F.col(id_col))
    counts = parsed(labelled.where("bad IS NOT NULL"), F.col("bad").cast("double").alias("bad")).groupBy("host", "shape").agg(F.lit(0).cast("long").alias("c"), F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad"))
    shapes = all_pages.groupBy("host", "shape").agg(F.count("*").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("bad"))
    shapes = shapes.union(counts).groupBy("host", "shape").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    # Rare children of nodes with many different ones become one wildcard child.
    parts = F.when(F.col("shape") == "", F.array()).otherwise(F.split("shape", "/"))
    steps = shapes.select("*", parts.alias("parts")).select("*", F.posexplode_outer("parts").alias("pos", "seg"))
    steps = steps.withColumn("parent", F.array_join(F.slice("parts", F.lit(1), F.coalesce("pos", F.lit(0))), "/"))
    children = steps.where("pos IS NOT NULL").groupBy("host", "parent", "seg").agg(F.sum("c").alias("child"))
    wide = children.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("child").alias("total")).where(F.col("children") > max_children)
    wild = children.join(wide, ["host", "parent"]).where(F.col("child") * max_children <= F.col("total")).select("host", "parent", "seg", F.lit("*").alias("wild"))
    named = steps.join(wild, ["host", "parent", "seg"], "left").groupBy("host", "shape", "n", "bad").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("wild", "seg").alias("seg"))))).alias("t"))
    named = scratch.keep(named.select("host", "shape", "n", "bad", F.col("t.seg").alias("t")), "templates")

    # Counts of every prefix, then of merged siblings.
    prefixes = F.transform(F.sequence(F.lit(0), F.size("t")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("t", F.lit(1), i), "/").alias("node"), F.array_join(F.slice("t", F.lit(1), F.greatest(i - 1, F.lit(0))), "/").alias("parent")))
    nodes = named.select("host", "n", "bad", F.explode(prefixes).alias("p")).groupBy("host", F.col("p.depth").alias("depth"), F.col("p.node").alias("node"), F.col("p.parent").alias("parent")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    nodes = scratch.keep(nodes, "nodes")
    n, bad = F.col("n"), F.col("bad")
    some = nodes.where("n > 0").groupBy("host", "depth", "parent").agg(F.array_sort(F.collect_list(F.struct((bad / n).alias("rate"), "node", "n", "bad"))).alias("children"))
    groups = F.aggregate("children", F.expr("CAST(array() AS array<struct<n: double, bad: double, nodes: array<string>>>)"), lambda done, x: _grouped(done, x, z))
    merged = some.select("host", "depth", F.explode(groups).alias("g")).select("host", "depth", F.explode("g.nodes").alias("node"), "g.n", "g.bad")
    own = merged.union(nodes.where("n = 0").select("host", "depth", "node", "n", "bad"))

    total = nodes.where("depth = 0").agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    prior = F.lit((total[1] + 1) / (total[0] + 2))
    templates = named.select("host", F.array_join("t", "/").alias("template"), F.explode(prefixes).alias("p")).select("host", "template", F.col("p.depth").alias("depth"), F.col("p.node").alias("node")).distinct()
    smooth = F.aggregate(F.array_sort("line"), prior, lambda p, x: (x["bad"] + strength * p) / (x["n"] + strength))
    judged = templates.join(own, ["host", "depth", "node"]).groupBy("host", "template").agg(F.collect_list(F.struct("depth", "n", "bad")).alias("line")).select("host", "template", (smooth > max_bad).alias("reject"))
    verdicts = named.select("host", "shape", F.array_join("t", "/").alias("template")).join(judged, ["host", "template"]).select("host", "shape", "reject")
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return all_pages.join(verdicts, ["host", "shape"]).select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
