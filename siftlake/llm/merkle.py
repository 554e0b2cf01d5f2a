"""Merkle manifest of a table: a digest for each row, one for each group, one for all, and a proof for each row.

A row's leaf is the hash of its fields. The leaves of a group, in the order of the key, are joined two by two, level by level, until one digest, the
group's subroot, remains; the subroots, in the order of the groups, are joined likewise to the root. A proof lists what a row's leaf meets on its
way to the root, so that anyone who knows the root can check the row alone.

Plan: leaves are written without their texts and numbered by ranges (`placed`), so that a group may hold any share of the rows. Bottom-up, each pass
joins BAND levels: 2**BAND neighbouring nodes are gathered to a block, and the block is written with all its levels, which are the children of the
next pass. Top-down, each block meets the proof of its node, and each child puts its own siblings before it. No group of rows is larger than a block,
and a table of n rows takes log2(n) / BAND passes each way; what is moved at each is a 2**BAND-th of the pass below.

Defined cases: a null field is written as `-`; an absent group (null) is a group of its own and comes first, before the empty string; a null key comes
first in its group and ties of keys are ordered by leaf, so that repeated rows are leaves each; a group of one row has its leaf as subroot; one group
has its subroot as root; an empty table gives no rows; very long texts are hashed whole; other columns are not read, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, placed

#: Levels of a pass; a block has two to this power of children.
BAND = 4
NO_PROOF = "CAST(array() AS array<struct<left: boolean, sibling: string>>)"


def field(value: Column) -> Column:
    """`-`, or the count of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Lower-case hexadecimal sha256 of the fields, one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """A string for each group, null included, in the order of their UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def _joined(level: Column) -> Column:
    """The next level: every two consecutive digests, the last maybe alone, become their hash."""
    pairs = F.filter(level, lambda _, i: i % 2 == 0)
    return F.transform(pairs, lambda x, i: F.sha2(F.concat(x, F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256))


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """g, block, total, levels, top and children (what is carried by each node) of blocks of nodes (g, place, total, digest)."""
    child = F.struct("place", "digest", *carried)
    out = nodes.groupBy("g", F.shiftright("place", BAND).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(child)).alias("children"))
    # A group of one block stops at one digest; any other has all levels of the pass, also where its last block holds a single node.
    depth = F.lit(0)
    for i in range(BAND):
        depth = depth + (F.col("total") > 1 << i).cast("int")
    out = out.withColumn("depth", depth).withColumn("l0", F.transform("children", lambda c: c["digest"]))
    for i in range(BAND):
        out = out.withColumn(f"l{i + 1}", F.when(F.col("depth") > i, _joined(F.col(f"l{i}"))))
    every = F.array(*[f"l{i}" for i in range(BAND + 1)])
    kept = F.transform("children", lambda c: F.struct(*[c[x].alias(x) for x in ["place", *carried]]))
    return out.select("g", "block", "total", F.slice(every, 1, F.col("depth")).alias("levels"), F.get(F.get(every, F.col("depth")), F.lit(0)).alias("top"), kept.alias("children"))


def _built(nodes: DataFrame, most: int, carried: list[str], scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The passes' written blocks, the leaves' first, and the last node of each group."""
    passes: list[DataFrame] = []
    while not passes or most > 1:
        passes.append(scratch.keep(_blocks(nodes, carried if not passes else []), f"{name}_{len(passes)}"))
        nodes = passes[-1].select("g", F.col("block").alias("place"), F.shiftright(F.col("total") + ((1 << BAND) - 1), BAND).alias("total"), F.col("top").alias("digest"))
        most = (most + (1 << BAND) - 1) >> BAND
    return passes, nodes


def _pushed(above: DataFrame, passes: list[DataFrame], carried: list[str], handed: list[str]) -> DataFrame:
    """The leaves (what they carry, their digest, their proof, and what is handed down to all) below the groups' last nodes (g, proof, what is handed down)."""
    parents = above.withColumn("block", F.lit(0).cast("long"))
    for i, blocks in reversed(list(enumerate(passes))):
        met = blocks.join(parents, ["g", "block"]).select("g", "levels", "top", "proof", *handed, F.posexplode("children").alias("j", "child"))
        siblings = F.expr("transform(levels, (v, i) -> named_struct('left', shiftright(j, i) % 2 = 1, 'sibling', get(v, shiftright(j, i) ^ 1)))")
        digest = F.coalesce(F.get(F.get("levels", F.lit(0)), F.col("j")), F.col("top")).alias("digest")
        down = [F.col("child.place").alias("block")] if i else [digest, *[F.col(f"child.{c}").alias(c) for c in carried]]
        parents = met.select("g", *down, F.concat(siblings, F.col("proof")).alias("proof"), *handed)
    return parents


def _most(spans: DataFrame) -> int:
    return spans.agg(F.max("total")).first()[0] or 0


def manifest(docs: DataFrame, fields: list[str], *, group: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof and the carried columns of every row.

    proof: what the leaf meets, level by level to the root: left (is it the left one) and sibling (null: nothing, the digest is hashed alone).
    carry: names to expressions over docs that are to go along, in a few bytes, such as another leaf to hold against the root. Names of docs' columns are
    free for it.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kept = {f"c{i}": (name, value) for i, (name, value) in enumerate((carry or {}).items())}
    rows = docs.select(group_key(F.col(f"`{group}`")).alias("g"), F.col(f"`{key}`").alias("key"), leaf_of(*[F.col(f"`{c}`") for c in fields]).alias("digest"), *[v.alias(k) for k, (_, v) in kept.items()])
    carried = ["key", *kept]
    leaves, spans = placed(scratch.keep(rows, "leaves"), "g", ["key", "digest"], scratch)
    passes, subroots = _built(leaves, _most(spans), carried, scratch, "level")
    groups = scratch.keep(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "subroots")
    tops, spans = placed(groups, "g", ["of"], scratch, "placed_subroots")
    upper, roots = _built(tops, _most(spans), ["of"], scratch, "upper")
    above = roots.select("g", F.col("digest").alias("root"), F.expr(NO_PROOF).alias("proof"))
    found = _pushed(above, upper, ["of"], ["root"]).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "proof")
    out = _pushed(found, passes, carried, ["subroot", "root"])
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(k).alias(name) for k, (name, _) in kept.items()])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    met = lambda a, s: F.when(s["sibling"].isNull(), a).when(s["left"], F.concat(s["sibling"], a)).otherwise(F.concat(a, s["sibling"]))
    return F.aggregate(proof, leaf, lambda a, s: F.sha2(met(a, s), 256))


def digest(proof: Column) -> Column:
    """Hash of a proof's siblings, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), ""), 256)
