"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import discard, materialize


def _star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Link every neighbour of a node to the smallest of them; edges holds (u, v), both ways where wanted.

    The minima are stored first and returned too: the join then sees two plain exchanges, which adaptive execution can
    split when one node has very many neighbours.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, label)
    return edges.join(least, "u").select("u", "v", "m"), least


def connected_components(edges: DataFrame, a: str, b: str, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Return (node, root): root is the smallest node reachable over the undirected edges (a, b).

    Loops, repeated edges and nulls are allowed: a loop makes its node a component, an edge with a null end
    is ignored. Each round costs work linear in the edges; a component of diameter d takes about log d rounds.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).union(both.select("v"))
    links = materialize(both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    for _ in range(max_rounds):
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, least = _star(around, label)
        large = materialize(starred.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        small, lower = _star(large, label)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        older, links = links, materialize(small.filter("u <> v").distinct(), label)
        discard(older, least, large, lower)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
