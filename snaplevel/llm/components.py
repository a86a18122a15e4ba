"""Connected components of links, in Spark: alternating large and small stars.

A large star links every larger neighbour of a node, a small star every smaller one, to the smallest node of
its neighbourhood; repeated until nothing changes, each node is linked to the smallest of its component. The
smallest neighbour is an aggregate with a map-side combine and comes back by a join, so a node that holds a
third of all links is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplevel.llm.common import saved


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root): the smallest node of the component, for every node but the smallest."""
    links = saved(links.filter("a != b").select("a", "b").distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        if not now[0]:
            break
        links = saved(_small(_large(links)), "stars")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
