"""Consolidating pairwise matches into groups: connected components by large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrain.session import cut


def is_filled(c: Column) -> Column:
    """Neither null nor only white space (Unicode)."""
    return c.isNotNull() & c.rlike(r"(?U)[^\s]")


def _smallest_parent(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each edge (a, b), a > b, becomes (a, smallest of b and b's neighbours): b's smaller neighbours are its parents."""
    m = _smallest_parent(edges)
    to = F.coalesce(F.col("least"), F.col("b"))
    return edges.join(m, edges["b"] == m["node"], "left").select("a", to.alias("b"), (to != F.col("b")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its parents are hung under its smallest parent."""
    m = _smallest_parent(edges)
    joined = edges.join(m, edges["a"] == m["node"]).select("a", "b", "least")
    pairs = F.array(
        F.struct(F.col("a").alias("a"), F.col("least").alias("b"), (F.col("b") != F.col("least")).alias("moved")),
        F.struct(F.col("b").alias("a"), F.col("least").alias("b"), (F.col("b") != F.col("least")).alias("moved")),
    )
    return joined.select(F.explode(pairs).alias("e")).select("e.*").filter("a <> b")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "b").agg(F.max("moved").alias("moved"))


def connected_groups(pairs: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, group) for every node of ``pairs``; group is the smallest node linked to it directly or indirectly.

    Alternates large-star and small-star until no edge moves; the number of rounds grows with the logarithm of the
    depth. Every step is a partially aggregated minimum and a join with it, one row per node: a hub's edges are
    never gathered, and adaptive execution splits its partition, since the other side has one row per key. Each
    round is checkpointed, so a lost executor costs no earlier round.

    Defined cases: pairs with a null end are left out; direction and repeats don't count; a pair of a node with
    itself makes it a group; an empty table gives no rows. Text is compared in UTF-8 byte order. If ``most_rounds``
    is not enough the call fails; it never returns an unfinished result.
    """
    ends = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null").distinct()
    ends = cut(ends)
    edges = ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    edges = cut(edges)
    for _ in range(most_rounds):
        large = _distinct(_large_star(edges.select("a", "b")))
        edges = cut(_distinct(_small_star(large.select("a", "b"))))
        # Settled: the small star moved nothing, so each node has one parent, and the large star would move nothing.
        if not edges.filter("moved").head(1) and not _large_star(edges.select("a", "b")).filter("moved").head(1):
            break
    else:
        raise RuntimeError(f"not settled after {most_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("group"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("group"))
    alone = ends.filter("x = y").select(F.col("x").alias("node"), F.col("x").alias("group"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("group").alias("group"))
