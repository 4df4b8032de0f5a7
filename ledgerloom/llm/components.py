"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rounds after which the loop gives up; the number needed grows with the logarithm of a path's length.
MAX_ROUNDS = 60


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(node, low, near): every neighbour of each node with the smallest of node and neighbours.

    The smallest is an aggregate (combined before the shuffle) joined back, so a node with a
    third of all links is never gathered in one place.
    """
    low = pairs.groupBy("node").agg(F.min("near").alias("low"))
    return pairs.join(low, "node").withColumn("low", F.least("node", "low"))


def large_star(links: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node with the node's smallest neighbour."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    return _with_minimum(both).where(F.col("near") > F.col("node")).select(F.col("near").alias("a"), F.col("low").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Connects a node and its smaller neighbours with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    found = _with_minimum(down)
    return found.select(F.explode(F.array("node", "near")).alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node of its component.

    Null ends, links of a node with itself and repeated links count for nothing; an empty table
    gives an empty table. Each round is written to the shared checkpoint folder. The loop
    ends when a round leaves the links as they were, which a count and a sum of hashes tell.
    """
    rows = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = cut_lineage(rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == mark:
            break
        mark = state
        now = cut_lineage(small_star(large_star(now)))
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
