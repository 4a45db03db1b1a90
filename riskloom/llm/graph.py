"""Connected components of a set of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize_measured


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One half-round: the neighbours of each node are linked to the smallest of them instead.

    The large star treats the neighbours above the node, the small star those below it. The minimum
    is a plain aggregate and the neighbours are joined to it, so a node with very many neighbours
    is split by the skew handling of the join and never gathered.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if larger:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        below = both.filter("b < a").join(least, "a")
        moved = below.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            below.select("a", F.col("m").alias("b")))
    return (moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternating large and small stars until nothing changes; each round is written to the shared
    folder, so a lost executor repeats one round at most. Empty links give an empty result.
    """
    tally = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    links = (links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    current, seen = materialize_measured(links, "links", **tally)
    while seen["n"]:
        current, after = materialize_measured(_stars(_stars(current, True), False), "links", **tally)
        if after == seen:
            break
        seen = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
