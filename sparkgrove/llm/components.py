"""Connected components by alternating stars, as joins over an edge table.

Large star and small star (Kiveris et al., 2014) alternate until every edge leads to a
node that no edge leaves. Every step is written to the shared folder, so lineage stays
short and a lost executor costs one step at most, and each join reads two written tables,
so that a node with very many edges is split among tasks. Nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize


def _lowest(directed: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) → u, v, m: the least of u and its neighbours beside each edge."""
    least = scratch.table(directed.groupBy("u").agg(F.min("v").alias("lv")), "least")
    return directed.join(least, "u").select("u", "v", F.least("u", "lv").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return per.where("out > 1 or out > 0 and into > 0").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges of comparable nodes → (node, root): root is the least node reachable.

    Self loops, repeated edges and edges with a null end are ignored; nodes without
    an edge are not listed; an empty table gives an empty one.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    with Scratch(edges.sparkSession) as scratch:
        at = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
        while not _stars(at):
            both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _lowest(both, scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            large = scratch.table(large, "large-star")
            small = _lowest(large, scratch)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            at = scratch.table(small.where("u != v").distinct(), "small-star")
        roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
