"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.io import checkpointed


def _fingerprint(links: DataFrame) -> tuple:
    """Number and order-free hash sums of distinct links: equal for equal sets, one small aggregation."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(nodes: DataFrame, links: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node it is linked with, over any number of links).

    Alternating large-star and small-star steps: each round is two aggregations over the links and at least
    halves the distance to the smallest node, so chains need logarithmically many rounds; a node linked with very many
    is never collected, as each step only takes minima. Nodes without links are components of their own; null ends
    and links of a node with itself don't count. Lineage is cut by a reliable checkpoint each round.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _fingerprint(e)
    while True:
        #: Large star: larger neighbours are linked with the smallest neighbour.
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        #: Small star: smaller neighbours and the node itself are linked with the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = checkpointed(new)
        e, before = new, state
        state = _fingerprint(e)
        if state == before:
            break
    found = e.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("component"))
    return nodes.select(node).distinct().join(found, node, "left").withColumn("component", F.coalesce("component", node))
