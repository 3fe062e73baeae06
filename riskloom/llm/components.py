"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """`node, root` for the nodes of `links` (`a, b`), root being the smallest node that
    is reachable. Nodes without links have no row; links of a node with itself say nothing.

    Rounds of two steps until all links lead to roots. First every node hands its larger
    neighbours to the smallest one around it, then its smaller ones and itself. Hubs are
    joined, not gathered: no task sees all neighbours of a node.
    """
    edges = materialize(_down(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    while not _settled(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        larger = both.where("b > a").join(least, "a")
        old, edges = edges, materialize(_down(larger.select(F.col("b").alias("a"), F.col("least").alias("b"))), "links")
        discard(old)
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        smaller = edges.join(least, "a")
        pairs = smaller.select(F.inline(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))))
        old, edges = edges, materialize(_down(pairs), "links")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (`node, root`) of the links behind `roots` and of further ones: only
    the roots that these lead to are looked at again."""

    def up(table: DataFrame, column: str) -> DataFrame:
        own = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return table.join(own, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")

    found = materialize(components(up(up(links.select("a", "b"), "a"), "b")), "joined")
    now = found.select(F.col("node").alias("root"), F.col("root").alias("_now"))
    old = roots.join(now, "root", "left").select("node", F.coalesce("_now", "root").alias("root"))
    return old.unionByName(found.join(roots.select("node"), "node", "left_anti"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, and to a node that has none to a smaller one."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not seen.agg(F.count_if(F.expr("up > 1 OR (up > 0 AND least = 0)"))).first()[0]


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
