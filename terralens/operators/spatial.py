"""Distance joins and point-in-region joins without a spatial index.

``distance_join`` is an equi-join on a latitude/longitude grid with an exact residual, ``points_in_regions``
is crossing parity over latitude strips. Both work on distinct coordinates and expand to ids afterwards, so
a place named in a third of all rows is computed once. No pair outside a shared cell or strip is formed.
Points out of range (|lat| > 90, |lon| > 180) or with a null coordinate are near nothing and in nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.io import broadcast_if_small

EARTH_M = 6371008.8
#: Semi-major axis and squared eccentricity of WGS84.
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165
#: Up to so many polygon edges times strips are broadcast; beyond, the join shuffles by strip.
MAX_BROADCAST_EDGES = 200_000
#: Width of a column of a latitude strip.
COLUMN_DEG = 1.0
#: Coordinates have six decimals, so twice an area is a multiple of 1e-12: less than half of that is rounding.
ON_EDGE = 5e-13
NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"


def point_of(geom: Column, axis: int) -> Column:
    """Longitude (``axis`` 0) or latitude (1) of a well-known-text point, with or without SRID or spaces; else null."""
    return F.regexp_extract(geom, rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*Z?\s*\(\s*({NUMBER})\s+({NUMBER})", axis + 1).try_cast("double")


def with_point(df: DataFrame, geom: str = "geom") -> DataFrame:
    """``df`` plus ``x, y`` parsed from its well-known text; rows without a point in range are dropped."""
    df = df.withColumns({"x": point_of(F.col(geom), 0), "y": point_of(F.col(geom), 1)})
    return df.where(F.col("x").between(-180, 180) & F.col("y").between(-90, 90))


def sphere_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres (haversine) on the mean sphere."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ellipsoid_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres on WGS84 by the local radii of curvature at the mean latitude; error below 1e-6 up to 30 km."""
    phi = F.radians((y1 + y2) / 2)
    w = F.sqrt(1 - WGS84_E2 * F.pow(F.sin(phi), 2))
    m = WGS84_A * (1 - WGS84_E2) / (w * w * w)
    n = WGS84_A / w
    return F.sqrt(F.pow(m * F.radians(y2 - y1), 2) + F.pow(n * F.cos(phi) * F.radians(x2 - x1), 2))


def distance_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_m: float, metric=sphere_m, on: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """Pairs ``on, left_id, right_id, dist_m`` at most ``radius_m`` apart, bounds included, each once.

    Both sides have ``x, y`` (degrees) and the columns ``on``, which must be equal in a pair (a type, a time bucket). A
    repeated (id, point) row counts once. The left side visits the cells its circle touches, the right side sits in one
    cell, so a pair meets in exactly one cell. With ``ordered`` only pairs with the smaller id left are formed, for two
    sides that are one table.
    """
    pairs, lp, rp = _near_coordinates(left, right, left_id, right_id, radius_m, metric, on)
    met = pairs.join(lp, [*on, "_x1", "_y1"])
    met = met.join(rp, [*on, "_x2", "_y2"]) if not ordered else met.join(rp.withColumnsRenamed({c: f"_on_{c}" for c in on}), [*[F.col(c) == F.col(f"_on_{c}") for c in on], met["_x2"] == rp["_x2"], met["_y2"] == rp["_y2"], F.col("_l") < F.col("_r")])
    return met.select(*on, F.col("_l").alias(left_id), F.col("_r").alias(right_id), "dist_m")


def _near_coordinates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_m: float, metric, on: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of distinct coordinates ``on, _x1, _y1, _x2, _y2, dist_m``, and the ids ``_l`` and ``_r`` at them."""
    deg = radius_m / EARTH_M * 180 / math.pi * 1.01  # a little more than either metric needs
    cell = 2 * deg
    #: A whole number of columns goes round the globe, so that the date line is no border.
    columns = max(1, math.floor(360 / cell))
    wide = 360 / columns
    lp = left.select(*on, F.col(left_id).alias("_l"), F.col("x").alias("_x1"), F.col("y").alias("_y1")).dropDuplicates()
    rp = right.select(*on, F.col(right_id).alias("_r"), F.col("x").alias("_x2"), F.col("y").alias("_y2")).dropDuplicates()

    def index(v: Column, size: float = cell) -> Column:
        return F.floor(v / size).cast("bigint")

    reach = F.when(F.abs("_y1") + deg >= 89.9, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(deg))) / F.cos(F.radians("_y1"))))))
    wrap = lambda c: F.pmod(c, F.lit(columns))
    lcells = (
        lp.select(*on, "_x1", "_y1").dropDuplicates()
        .withColumn("_cy", F.explode(F.sequence(index(F.col("_y1") - deg), index(F.col("_y1") + deg))))
        .withColumn("_cx", F.explode(F.array_distinct(F.transform(F.sequence(index(F.col("_x1") + 180 - reach, wide), index(F.col("_x1") + 180 + reach, wide)), wrap))))
    )
    rcells = rp.select(*on, "_x2", "_y2").dropDuplicates().withColumns({"_cy": index(F.col("_y2")), "_cx": wrap(index(F.col("_x2") + 180, wide))})
    pairs = (
        lcells.join(rcells, [*on, "_cy", "_cx"])
        .withColumn("dist_m", metric(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")))
        .where(F.col("dist_m") <= radius_m)
        .select(*on, "_x1", "_y1", "_x2", "_y2", "dist_m")
    )
    return pairs, lp, rp


def near_places(left: DataFrame, right: DataFrame, radius_m: float, metric=sphere_m) -> DataFrame:
    """Pairs of distinct coordinates ``x1, y1, x2, y2, dist_m`` at most ``radius_m`` apart: the distance join before it is expanded to ids.

    With each side's own ids by coordinate this holds every pair of ids, in as many rows as there are pairs of places.
    """
    one = F.lit(1).alias("_one")
    pairs, _, _ = _near_coordinates(left.select("x", "y", one), right.select("x", "y", one), "_one", "_one", radius_m, metric, ())
    return pairs.withColumnsRenamed({"_x1": "x1", "_y1": "y1", "_x2": "x2", "_y2": "y2"})


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_m: float, metric=sphere_m, priority: str | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """For each left id its best right id within ``radius_m``: lowest ``priority``, then nearest, then smallest id.

    Places are compared, not ids: of the right ids at one place only the best takes part, and the best of each left
    place is found before it is expanded to the ids there.
    """
    rank = F.col(priority) if priority else F.lit(0)
    spots = right.groupBy(*on, "x", "y").agg(F.min(F.struct(rank.alias("p"), F.col(right_id).alias("id"))).alias("_best"))
    pairs, lp, rp = _near_coordinates(left, spots, left_id, "_best", radius_m, metric, on)
    best = F.min(F.struct(F.col("_r.p").alias("p"), F.col("dist_m"), F.col("_r.id").alias("id"))).alias("b")
    places = pairs.join(rp, [*on, "_x2", "_y2"]).groupBy(*on, "_x1", "_y1").agg(best)
    return lp.join(places, [*on, "_x1", "_y1"]).groupBy(F.col("_l").alias(left_id)).agg(F.min("b").alias("b")).select(left_id, F.col("b.id").alias(right_id), "b.dist_m")


def boundary_m(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, within_m: float) -> DataFrame:
    """``point_id, region_id, dist_m``: points at most ``within_m`` metres from a region's boundary, inside or outside, with the distance to it.

    Edges are cut into pieces of at most one grid cell and put into the cells within reach, points into their own. The
    distance to an edge is planar in the local radii of the ellipsoid at the point (error below 1e-4 up to 30 km).
    Points without coordinates and regions without edges are near nothing.
    """
    deg = within_m / EARTH_M * 180 / math.pi * 1.01
    edges = region_edges(regions, region_id)
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / deg)).cast("int")
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    pieces = edges.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pieces = pieces.select(region_id, at("x1", "x2", F.col("_i") / F.col("_n")).alias("ax"), at("y1", "y2", F.col("_i") / F.col("_n")).alias("ay"), at("x1", "x2", (F.col("_i") + 1) / F.col("_n")).alias("bx"), at("y1", "y2", (F.col("_i") + 1) / F.col("_n")).alias("by"))
    top = F.least(F.lit(89.0), F.greatest(F.abs("ay"), F.abs("by")) + deg)
    reach = deg / F.cos(F.radians(top))
    low, high = (lambda a, b, r: F.floor((F.least(a, b) - r) / deg).cast("bigint")), (lambda a, b, r: F.floor((F.greatest(a, b) + r) / deg).cast("bigint"))
    cells = pieces.withColumn("_cy", F.explode(F.sequence(low("ay", "by", F.lit(deg)), high("ay", "by", F.lit(deg))))).withColumn("_cx", F.explode(F.sequence(low("ax", "bx", reach), high("ax", "bx", reach))))
    ids = points.select(point_id, "x", "y").dropDuplicates()
    spots = ids.select("x", "y").dropDuplicates().withColumns({"_cy": F.floor(F.col("y") / deg).cast("bigint"), "_cx": F.floor(F.col("x") / deg).cast("bigint")})
    w = F.sqrt(1 - WGS84_E2 * F.pow(F.sin(F.radians("y")), 2))
    north, east = F.lit(math.pi / 180 * WGS84_A * (1 - WGS84_E2)) / (w * w * w), F.lit(math.pi / 180 * WGS84_A) / w * F.cos(F.radians("y"))
    ux, uy, px, py = (F.col("bx") - F.col("ax")) * east, (F.col("by") - F.col("ay")) * north, (F.col("x") - F.col("ax")) * east, (F.col("y") - F.col("ay")) * north
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(ux * px + uy * py, ux * ux + uy * uy), F.lit(0.0))))
    met = spots.join(cells, ["_cy", "_cx"]).withColumn("dist_m", F.sqrt(F.pow(px - t * ux, 2) + F.pow(py - t * uy, 2))).where(F.col("dist_m") <= within_m)
    return met.groupBy("x", "y", region_id).agg(F.min("dist_m").alias("dist_m")).join(ids, ["x", "y"]).select(point_id, region_id, "dist_m")


def region_edges(regions: DataFrame, region_id: str, geom: str = "geom") -> DataFrame:
    """Edges ``region_id, x1, y1, x2, y2`` and the region's box of polygons or multipolygons in well-known text.

    Holes need no mark: crossing parity counts them. An unclosed ring is closed. Rings of other text
    (null, empty, no numbers) give no edges.
    """
    ring = F.explode(F.regexp_extract_all(F.col(geom), F.lit(r"\(([^()]+)\)"), F.lit(1)))
    rings = regions.select(F.col(region_id), ring.alias("_ring"))
    pairs = F.transform(F.split(F.trim("_ring"), r"\s*,\s*"), lambda p: F.transform(F.slice(F.split(F.trim(p), r"\s+"), 1, 2), lambda c: c.try_cast("double")))
    rings = rings.withColumn("_p", F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())).where(F.size("_p") >= 3)
    ends = F.concat(F.slice("_p", 2, F.size("_p") - 1), F.slice("_p", 1, 1))
    edges = rings.select(region_id, F.explode(F.arrays_zip(F.col("_p").alias("a"), ends.alias("b"))).alias("e"))
    edges = edges.select(region_id, F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))
    return edges.where(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, strip_deg: float = 0.05) -> DataFrame:
    """Pairs ``point_id, region_id`` of points inside a region or on its boundary (a hole's boundary too).

    ``points`` has ``x, y``. Edges are put into every latitude strip they touch, and there into the columns from the
    region's western end to their own eastern one; points into their one strip and column. So a point meets only edges of
    regions that reach round it; it is inside where the ray to the east crosses an odd number of the region's edges.
    Boundary points are found by an explicit on-segment test, horizontal edges by that test alone.
    """
    edges = region_edges(regions, region_id)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    strips = edges.withColumn("_strip", F.explode(F.sequence(F.floor(low / strip_deg), F.floor(high / strip_deg))))
    west = F.min(F.least("x1", "x2")).over(Window.partitionBy(region_id, "_strip"))
    strips = strips.withColumn("_west", west)
    strips = strips.withColumn("_column", F.explode(F.sequence(F.floor(F.col("_west") / COLUMN_DEG), F.floor(F.greatest("x1", "x2") / COLUMN_DEG)))).drop("_west")
    strips = broadcast_if_small(strips, MAX_BROADCAST_EDGES)
    ids = points.select(point_id, "x", "y").dropDuplicates()
    spots = ids.select("x", "y").dropDuplicates().withColumns({"_strip": F.floor(F.col("y") / strip_deg), "_column": F.floor(F.col("x") / COLUMN_DEG)})
    x, y = F.col("x"), F.col("y")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    #: Twice the signed area of (edge, point); its sign tells the side without a division.
    side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    crosses = ((y1 > y) != (y2 > y)) & F.when(y2 > y1, side > 0).otherwise(side < 0)
    on_edge = (F.abs(side) < ON_EDGE) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(low, high)
    hits = spots.join(strips, ["_strip", "_column"]).where(x <= F.greatest(x1, x2)).where(crosses | on_edge)
    inside = (
        hits.groupBy("x", "y", region_id)
        .agg(F.sum(crosses.cast("int")).alias("n"), F.max(on_edge).alias("edge"))
        .where((F.col("n") % 2 == 1) | F.col("edge"))
        .select("x", "y", region_id)
    )
    return inside.join(ids, ["x", "y"]).select(point_id, region_id)
