"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import stored


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node only, and that one on none. ``b`` is the smaller end, so these are stars
    on the smallest nodes of their components. Edges do not repeat."""
    both = edges.select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")))
    ends = both.groupBy("a").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not ends.where("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node now hangs on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, now hang on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node with an edge; root is the smallest node of its component, which is
    not listed itself.

    Edges may repeat and point either way; loops and edges with a null end are left out. Every round is
    a written table, so a lost executor repeats one round at most. Minima are aggregated before the
    shuffle, and a node with very many neighbours meets them in a join that Spark can split. No round is
    made once the edges are stars. No edges: no rows.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    ends = known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stored(ends, "edges")
    while not _settled(now):
        now = stored(_small_star(_large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
