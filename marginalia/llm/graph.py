"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch
from marginalia.operators.ranking import split_join


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component, as ``(node, component)``.

    ``links`` has two long columns ``a`` and ``b``; direction, repeats and self-links do not
    matter. Nodes without a link to another node are not in the result. Each round turns every
    neighbourhood into a star around its smallest node, first towards larger nodes, then among
    smaller ones; rounds grow with the logarithm of the size. Minima are aggregates, and the links
    of a node that has very many are counted and dealt over many tasks.
    Every round is written to the shared folder.
    """
    edges = scratch.save(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before or not state[0]:
            break
        before = state
        stars = scratch.save(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges = stars
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        split_join(both, low, ["a"])
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = split_join(edges, low, ["a"]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
