"""Connected components by alternating large and small stars.

A hub's least neighbour is found by partial minima and handed back in place where the hub
has many links, so no task takes all links of a node.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach, kept


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        attach(both, least, ["u"]).where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        attach(down, least, ["u"])
        .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                F.col("m").alias("v"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (u, v): the least node it reaches.

    Each round is written to the shared folder, so the plan stays short and a lost
    executor costs one round; the number of rounds grows with the logarithm of the
    longest chain. The least node of a component is in the result as well.
    """
    edges = kept(links.where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        edges = kept(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
