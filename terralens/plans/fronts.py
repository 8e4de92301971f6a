"""The control map as of an instant, built from two providers' polygons and the claims since: layers, areas, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.io import checkpointed, table
from terralens.operators import overlay, spatial
from terralens.plans.serving import NOW_S, sec

#: A claim's halo in metres; the least area of a disputed piece and the plausible band of a layer's area in square kilometres.
HALO_M, SLIVER_KM2, BAND_KM2 = 1500.0, 0.5, (50_000.0, 250_000.0)


def applied_claims(claims: DataFrame, baseline_s: int, at_s: int) -> DataFrame:
    """``effect, geom``: the halos of claims confirmed after the baselines and not after the instant (``add`` or ``cut``), and of pending ones created by then (``pending``)."""
    c = spatial.with_point(claims.select("geom", "status", "direction", sec("created_at").alias("created_s"), sec("resolved_at").alias("resolved_s")))
    confirmed = (F.col("status") == "confirmed") & (F.col("resolved_s") > baseline_s) & (F.col("resolved_s") <= at_s)
    effect = F.when(confirmed & (F.col("direction") == "ru_advance"), "add").when(confirmed & (F.col("direction") == "ua_advance"), "cut").when((F.col("status") == "pending") & (F.col("created_s") <= at_s), "pending")
    return c.select(effect.alias("effect"), overlay.buffer_wkt(F.col("x"), F.col("y"), HALO_M).alias("geom")).where("effect IS NOT NULL")


def build_layers(baselines: DataFrame, effects: DataFrame, sliver_km2: float = SLIVER_KM2) -> DataFrame:
    """Trapezoids with ``layer``: ``agreed``, ``disputed`` (pieces of at least ``sliver_km2``), ``held`` and ``grey``; one may be in several layers.

    ``baselines`` has ``provider, geom`` of up to two providers, ``effects`` ``effect, geom`` (``add, cut, pending, grey``).
    ``agreed`` is what all providers cover, ``disputed`` what only one does, ``held`` is agreed or added and not cut,
    ``grey`` is disputed, pending or declared grey and not added. With one provider all it covers is agreed. All set
    operations are filters over one overlay.
    """
    providers = sorted(r[0] for r in baselines.where("geom IS NOT NULL").select("provider").distinct().limit(3).collect())
    if len(providers) > 2:
        raise ValueError("at most two providers")
    both = baselines.select(F.concat(F.lit("provider:"), "provider").alias("layer"), "geom").unionByName(effects.select(F.col("effect").alias("layer"), "geom"))
    t = checkpointed(overlay.overlay(both, "layer"))
    has = lambda name: F.array_contains("layers", name)
    covered = sum((has(f"provider:{p}").cast("int") for p in providers), F.lit(0))
    t = t.withColumns({"_agreed": (covered == len(providers)) & F.lit(bool(providers)), "_some": covered > 0})
    disputed = overlay.without_slivers(t.where("_some AND NOT _agreed"), sliver_km2 * 1e6).select(*t.columns).withColumn("_disputed", F.lit(True))
    keys = ["x0", "x1", "lo0", "lo1", "hi0", "hi1"]
    t = t.join(disputed.select(*keys, "_disputed"), keys, "left").withColumn("_disputed", F.coalesce("_disputed", F.lit(False)))
    layers = {"agreed": F.col("_agreed"), "disputed": F.col("_disputed"), "held": (F.col("_agreed") | has("add")) & ~has("cut"), "grey": (F.col("_disputed") | has("pending") | has("grey")) & ~has("add")}
    named = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in layers.items()]), lambda x: x.isNotNull())
    return t.withColumn("layer", F.explode(named)).drop("_agreed", "_some", "_disputed")


def plausible(km2: Column) -> Column:
    """Whether a layer's area lies in the band; null for null."""
    return km2.between(*BAND_KM2)


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active zones as one provider's polygons and the others as the second's; claims since 2024."""
    zones = table(spark, sf_dir, "blackout_zones").select(F.when(F.col("active"), "a").otherwise("b").alias("provider"), "geom")
    return build_layers(zones, applied_claims(table(spark, sf_dir, "frontline_claims"), 1704067200, NOW_S))


def front_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square kilometres of each layer and whether that is plausible."""
    km2 = overlay.with_area(_layers(spark, sf_dir)).groupBy("layer").agg(F.round(F.sum("area_m2") / 1e6, 3).alias("km2"))
    return km2.withColumn("plausible", plausible(F.col("km2")))


def front_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer's connected pieces as GeoJSON with their area."""
    pieces = overlay.polygons(_layers(spark, sf_dir).drop("layers"), ("layer",))
    return pieces.select("layer", overlay.geojson(F.col("geom")).alias("geojson"), F.round(F.col("area_m2") / 1e6, 3).alias("km2"))


_ALL = ((front_layers, None), (front_polygons, None))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: q for f, q in _ALL if q}
