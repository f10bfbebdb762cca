"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.sources.scratch import stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links from every larger neighbour of a node to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("least").alias("a"), "b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links from a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").select(F.col("least").alias("a"), F.col("a").alias("b"))
    itself = least.select(F.col("least").alias("a"), "b")
    return moved.unionByName(itself).where(F.col("a") < F.col("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: the smallest node that each linked node reaches.

    ``links`` has two columns of the same ordered type; loops and repeated links do no
    harm. Smallest nodes are their own component. The links are stored after each round,
    which takes a number of rounds in the logarithm of the longest chain; nothing but two
    numbers a round reaches the driver.
    """
    edges = links.select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b")
    ).where(F.col("a") < F.col("b"))
    edges = stored(edges.distinct(), "links")
    sign = None
    for _ in range(MAX_ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == sign:
            break
        sign = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
