"""Clusters of records that lie near each other in space and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators import spatial
from terralens.operators.graph import connected_components
from terralens.operators.relational import sessions


def space_time_clusters(points: DataFrame, key: str, kind: str, at: str, radius_m: float, gap_s: int, metric=spatial.ellipsoid_m) -> DataFrame:
    """``key, cluster, members, links``: the class of each record, its size, and the number of records linked with it.

    Records of one ``kind`` are linked if they lie at most ``radius_m`` and ``gap_s`` seconds apart; classes are the
    connected ones, named by their smallest ``key``. ``points`` has ``x, y`` and whole seconds ``at``; rows with a null in
    any of these are left out, a repeated row counts once.

    Scale. Records at one place chain up in time first, so a place of a third of all records is a few nodes; only
    places near each other and near in time, by kind and bucket of time, are compared, and links between nodes are all
    that is held. The number of links of a record is counted from counts by place and second, never by listing pairs.
    """
    rows = points.select(key, F.col(kind).alias("_kind"), "x", "y", F.col(at).cast("bigint").alias("_at")).where("_kind IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND _at IS NOT NULL").distinct()
    chained = sessions(rows, ["_kind", "x", "y"], "_at", gap_s).withColumn("node", F.xxhash64("_kind", "x", "y", "session"))
    nodes = chained.groupBy("node", "_kind", "x", "y").agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    pairs = _near_nodes(nodes, radius_m, gap_s, metric)
    #: Two chains are linked if any of their records are: their spans may overlap without that.
    times = chained.select("node", "_at").distinct()
    linked = _linked(pairs, times, gap_s)
    found = connected_components(nodes, linked.where("a < b"))
    named = chained.join(found, "node")
    classes = named.groupBy("component").agg(F.min(key).alias("cluster"), F.count(F.lit(1)).alias("members"))
    degree = _degrees(chained, linked, key, gap_s)
    return named.join(classes, "component").select(key, "_kind", "x", "y", "_at", "cluster", "members").join(degree, [key, "_kind", "x", "y", "_at"]).select(key, "cluster", "members", "links")


def _near_nodes(nodes: DataFrame, radius_m: float, gap_s: int, metric) -> DataFrame:
    """Pairs ``a, b`` (both ways) of nodes of one kind at different places near each other whose spans come within ``gap_s``."""
    bucket = max(gap_s, 1)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket)))
    left = nodes.withColumnRenamed("node", "a").withColumn("_bucket", span(F.col("first") - gap_s, F.col("last") + gap_s))
    right = nodes.withColumnRenamed("node", "b").withColumn("_bucket", span(F.col("first"), F.col("last")))
    return spatial.distance_join(left, right, "a", "b", radius_m, metric, ("_kind", "_bucket")).where("a <> b").select("a", "b").distinct()


def _linked(pairs: DataFrame, times: DataFrame, gap_s: int) -> DataFrame:
    """The pairs of which some times are at most ``gap_s`` apart: within a pair's times, sorted, two neighbours of different nodes."""
    both = pairs.withColumn("p", F.struct("a", "b")).select("p", F.explode(F.array("a", "b")).alias("node")).join(times, "node")
    w = Window.partitionBy("p").orderBy("_at", "node")
    both = both.withColumns({"_n": F.lag("node").over(w), "_t": F.lag("_at").over(w)}).where((F.col("_n") != F.col("node")) & (F.col("_at") - F.col("_t") <= gap_s))
    return both.select("p.a", "p.b").distinct()


def _degrees(chained: DataFrame, linked: DataFrame, key: str, gap_s: int) -> DataFrame:
    """How many other records each is linked with, from running counts by node and second on both sides of its window."""
    counts = chained.groupBy("node", "_at").agg(F.count(F.lit(1)).alias("n"))
    own = chained.select("node").distinct().select(F.col("node").alias("a"), F.col("node").alias("b"))
    near = linked.select("a", "b").union(own)
    asked = counts.select(F.col("node").alias("a"), "_at").join(near, "a")
    events = counts.select(F.col("node").alias("b"), F.col("_at").alias("t"), F.col("n"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("_at"), F.lit(1).alias("q"))
    #: One query before the window's first second and one at its last; their difference is the count inside.
    asks = asked.select("b", F.explode(F.array(F.struct((F.col("_at") - gap_s - 1).alias("t"), F.lit(-1).alias("sign")), F.struct((F.col("_at") + gap_s).alias("t"), F.lit(1).alias("sign")))).alias("e"), "a", "_at")
    asks = asks.select("b", "e.t", F.lit(0).cast("bigint").alias("n"), "a", "_at", F.col("e.sign").alias("q"))
    stream = events.withColumn("ask", F.lit(0)).unionByName(asks.withColumn("ask", F.lit(1)))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0))
    inside = stream.withColumn("_upto", upto).where("ask = 1").groupBy(F.col("a").alias("node"), "_at").agg((F.sum(F.col("q") * F.col("_upto")) - 1).alias("links"))
    return chained.join(inside, ["node", "_at"]).select(key, "_kind", "x", "y", "_at", "links")
