"""Connected components of a graph of links, in rounds that each cut the work left.

Every node looks at its smallest neighbour; the links are then drawn between what nodes
point to, and pointers are followed to their ends (alternating large-star and small-star
steps, Kiveris et al., SoCC 2014). The number of rounds grows with the logarithm of the
longest path. Each step is a minimum per node, summed up before the shuffle, and a plain
equality join whose hot side Spark's adaptive execution can split. Rounds are written as
tables, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import few
from contactloom.session import stage


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links the neighbours of each node (the larger ones, or the node and the smaller ones)
    to the smallest node around it."""
    around = links
    if both_ways:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    centres = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = around.join(centres, "a")
    if both_ways:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            centres.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node it can reach.

    Links of a node to itself and those with a null end are left out.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    current = stage(down.distinct(), "links")
    while True:
        rows = current.count()
        current = few(current, rows)
        # Done when no node that others point to points on.
        centres = current.select(F.col("b").alias("a")).distinct()
        if rows == 0 or current.join(centres, "a", "left_semi").isEmpty() and _pointed_once(current):
            break
        current = stage(few(_star(_star(current, True), False).distinct(), rows), "links")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _pointed_once(links: DataFrame) -> bool:
    """Whether every node has one link at most."""
    return links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
