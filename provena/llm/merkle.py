"""Merkle manifest of a dataset with nested-interval labels.

Each row is a leaf; per source, leaves in order of their id get ranks, and every node covers an interval of ranks. Runs of
16 consecutive nodes become a parent that covers their intervals together, until one node, the source's subroot, is left;
subroots in order of their sources make a tree of the same kind. A node's ancestors are found by joins on a level and the
bucket of ranks there, with containment of intervals as the condition; what a parent's interval holds beside the node's own
are its siblings. Everything is built-in functions; no source, run of copies or level is ever gathered in one task.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import doc_hash_remainder, materialize

FAN = 16
DIGEST = 64  # characters of a digest as hex text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_FOREST = "forest"  # the one group of the tree over subroots


def field(value: Column) -> Column:
    """A value as a digest takes it in: - for null, else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """The digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*(field(replaced.get(c, F.col(c))) for c in FIELDS)), 256)


def group_key(source: Column) -> Column:
    """A source as a key that is never null and sorts as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Add rank, from 0 within each group by the order, and size, the group's number of rows.

    Rows are dealt by ranges of group and order and stored, which fixes their places; a rank is the place within its
    partition and group plus what earlier partitions hold of the group. Only counts by partition and group meet: as many
    as there are partitions and groups, so that a hot group is spread over partitions and never sorted by one task.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(placed.withColumn("part", F.spark_partition_id()).withColumn("place", place), label)
    counts = placed.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    out = placed.join(counts, [group, "part"])
    return out.withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


NODE = ("grp", "size", "level", "lo", "hi", "digest", "run")


class Tree(NamedTuple):
    """Nodes over the leaves of each group, all stored: (grp, size, level, lo, hi, digest), and above the leaves run.

    lo and hi are the first and last leaf rank that a node covers, run the digests of its children one after the other.
    levels[0] are the leaves, with what else they carry; tops holds each group's last node.
    """

    levels: list[DataFrame]
    tops: DataFrame


def plant(leaves: DataFrame, label: str) -> Tree:
    """Build the levels over leaves (grp, size, rank, digest, and more); a group is done at the level where it has one node."""
    most = leaves.agg(F.max("size").alias("m")).first()["m"] or 0
    own = {"level": F.lit(0), "lo": F.col("rank"), "hi": F.col("rank"), "run": F.lit(None).cast("string")}
    nodes = leaves.withColumns(own).drop("rank")
    levels, tops, width = [nodes], nodes.filter("size = 1"), 1
    while width < most:
        below, width = levels[-1].filter(F.col("size") > width), width * FAN
        inside = F.array_sort(F.collect_list(F.struct("lo", "digest")))  # at most FAN of them
        made = below.groupBy("grp", F.floor(F.col("lo") / F.lit(width)).alias("bucket")).agg(
            F.first("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.array_join(F.transform(inside, lambda x: x["digest"]), "").alias("run"),
        )
        made = made.withColumns({"level": F.lit(len(levels)), "digest": F.sha2("run", 256)}).select(*NODE)
        levels.append(materialize(made, f"{label}-level"))
        tops = tops.unionByName(levels[-1].filter(F.col("size") <= width), allowMissingColumns=True)
    return Tree(levels, tops)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Every leaf with its path: the runs that it and its ancestors stand in, from the leaf up.

    A step holds the run's text and the place of the node in it. above (grp, path, and more) gives each group's path beyond
    its top and what else its leaves are to carry. Steps go from the tops down; a level's nodes meet their parents by
    group, bucket and containment.
    """
    extra = [c for c in tree.levels[0].columns if c not in NODE]
    rest = [c for c in above.columns if c not in ("grp", "path")]
    held, found = tree.tops.join(above, "grp"), None
    for level in range(len(tree.levels) - 1, -1, -1):
        width = FAN**level
        names = ["grp", "lo", "hi", "digest", *([] if level else extra), *rest]
        here = held.filter(F.col("level") == level).select(*names, "path", F.col("run").alias("own_run"))
        if found is not None:
            bucket = F.floor(F.col("lo") / F.lit(width * FAN)).alias("bucket")
            parents = found.select("grp", bucket, F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "own_run", F.col("path").alias("p_path"), *rest)
            met = tree.levels[level].filter(F.col("size") > width).withColumn("bucket", bucket).join(parents, ["grp", "bucket"]).filter("p_lo <= lo and hi <= p_hi")
            step = F.struct(F.col("own_run").alias("run"), F.floor((F.col("lo") - F.col("p_lo")) / F.lit(width)).cast("int").alias("at"))
            here = here.unionByName(met.select(*names, F.concat(F.array(step), "p_path").alias("path"), F.col("run").alias("own_run")))
        found = here
    return found.select(*extra, F.col("lo").alias("rank"), "digest", "path", *rest)


def _before(s: Column) -> Column:
    return F.substring(s["run"], F.lit(1), s["at"] * DIGEST)


def _after(s: Column) -> Column:
    return F.substring(s["run"], s["at"] * DIGEST + DIGEST + 1, F.length(s["run"]))


def siblings(path: Column) -> Column:
    """The digests beside a leaf and its ancestors, level by level upwards, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(_before(s), _after(s))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(_before(s), acc, _after(s)), 256))


class Manifest(NamedTuple):
    """The trees within sources and over their subroots, and the root, null where there are no documents.

    Leaves carry doc_id and tampered; the leaves of the forest carry member, the group they are the subroot of.
    """

    within: Tree
    forest: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """All nodes within sources: (grp, level, lo, hi, digest)."""
        each = [level.select("grp", "level", "lo", "hi", "digest") for level in self.within.levels]
        return functools.reduce(DataFrame.unionByName, each)


def build(docs: DataFrame, tampered: Column) -> Manifest:
    """Digest the documents and build both trees; tampered is a second digest that each leaf carries along.

    Nulls have a mark of their own in digests, an empty text is a text of no bytes, texts are digested whole. Null ids
    come first within their source; rows that share an id stand in the order of their digests, repeated rows beside each
    other. Further columns are not looked at. No documents give trees without nodes and no root.
    """
    made = docs.select("doc_id", group_key(F.col("source")).alias("grp"), leaf_digest().alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = ranked(materialize(made, "merkle-digests"), "grp", ["doc_id", "digest", "tie"], "merkle-places")
    within = plant(materialize(leaves.drop("tie"), "merkle-leaves"), "merkle")
    tops = within.tops.select(F.lit(_FOREST).alias("grp"), F.col("grp").alias("member"), "digest")
    forest = plant(materialize(ranked(tops, "grp", ["member"], "merkle-places"), "merkle-subroots"), "merkle-forest")
    found = forest.tops.select("digest").first()
    return Manifest(within, forest, found["digest"] if found else None)


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, tampered) of every leaf; path leads from it to the root."""
    ends = m.forest.tops.select("grp", F.array().cast("array<struct<run:string,at:int>>").alias("path"))
    above = paths(m.forest, ends).select(F.col("member").alias("grp"), "path", F.col("digest").alias("subroot"))
    return paths(m.within, above).select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), "path", "tampered")


def lowered(share: int = 5) -> Column:
    """The digest of a document whose text has its A-Z lowered, where the share divides the checksum of its id; else null."""
    return F.when(doc_hash_remainder(F.col("doc_id"), share) == 0, leaf_digest(text=F.translate("text", UPPER, LOWER)))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Proof of every document: leaf, subroot, root, the hash of its siblings, and the root that follows from its tampered digest.

    A document without a tampered digest is folded with its own, so that it is verified; so is one that tampering leaves as it is.
    """
    rows = proofs(build(docs, lowered() if tampered is None else tampered))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
