"""Distance and region joins against brute force."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralens.operators import spatial as G


def haversine(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * G.EARTH_M * math.asin(math.sqrt(min(1, h)))


def _points(spark, pts, key):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], f"{key} bigint, x double, y double")


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(30, 30.4), rng.uniform(48, 48.3)) for _ in range(150)]
    pts += [(179.99, 10.0), (-179.99, 10.0), (0.0, 89.99), (180.0, 89.99), (12.0, -89.999), (30.1, 48.1), (30.1, 48.1)]
    for radius in (3000.0, 5000.0):
        got = {(r["a"], r["b"]) for r in G.distance_join(_points(spark, pts, "a"), _points(spark, pts, "b"), "a", "b", radius).collect()}
        assert got == {(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if haversine(p, q) <= radius}


def test_bound_is_included_and_repeats_count_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "a bigint, x double, y double")
    b = spark.createDataFrame([(5, 0.0, 0.01), (5, 0.0, 0.01)], "b bigint, x double, y double")
    assert G.distance_join(a, b, "a", "b", haversine((0, 0), (0, 0.01))).count() == 1


def test_nearest_and_priority(spark):
    a = _points(spark, [(30.0, 48.0)], "a")
    b = spark.createDataFrame([(1, 30.001, 48.0, 2), (2, 30.01, 48.0, 1), (3, 30.01, 48.0, 1)], "b bigint, x double, y double, p int")
    assert G.nearest_join(a, b, "a", "b", 5000.0).first()["b"] == 1
    assert G.nearest_join(a, b, "a", "b", 5000.0, priority="p").first()["b"] == 2


def test_points_in_wkt_forms(spark):
    df = spark.createDataFrame([(1, "POINT (1.5 2)"), (2, "POINT(1.5 2)"), (3, "SRID=4326;POINT (1.5 2)"), (4, "point ( -1.5e0  2 )"), (5, None), (6, ""), (7, "POINT EMPTY"), (8, "POINT (200 2)"), (9, "x" * 50_000)], "id bigint, geom string")
    assert {r["id"]: (r["x"], r["y"]) for r in G.with_point(df).collect()} == {1: (1.5, 2), 2: (1.5, 2), 3: (1.5, 2), 4: (-1.5, 2)}


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"


def test_regions_holes_and_boundaries(spark):
    pts = {"inside": (0.5, 0.5), "hole": (2, 2), "edge": (4, 2), "corner": (0, 0), "bottom": (2, 0), "hole edge": (1, 2), "out": (5, 2), "level with corner": (-1, 0), "slanted": (0.3, 3.999)}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "id string, x double, y double")
    zones = spark.createDataFrame([(1, SQUARE), (2, None), (3, ""), (4, "POLYGON EMPTY"), (5, "multipolygon (((10 10, 11 10, 11 11)), ((0 0,0.2 0,0.2 0.2)))")], "zone int, geom string")
    got = {r["id"] for r in G.points_in_regions(df, zones.where("zone < 5"), "id", "zone").collect()}
    assert got == {"inside", "edge", "corner", "bottom", "hole edge", "slanted"}
    assert {(r["id"], r["zone"]) for r in G.points_in_regions(df, zones, "id", "zone").where("zone = 5").collect()} == {("corner", 5)}
    assert G.points_in_regions(df.limit(0), zones, "id", "zone").count() == 0
    assert G.points_in_regions(df, zones.limit(0), "id", "zone").count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10_000))
def test_regions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    stars = []
    for z in range(3):
        cx, cy, n = rng.uniform(20, 21), rng.uniform(45, 46), 11
        stars.append([(round(cx + rng.uniform(0.1, 0.6) * math.cos(2 * math.pi * k / n), 6), round(cy + rng.uniform(0.1, 0.6) * math.sin(2 * math.pi * k / n), 6)) for k in range(n)])
    pts = [(round(rng.uniform(19.5, 21.5), 6), round(rng.uniform(44.5, 46.5), 6)) for _ in range(200)]

    def inside(p, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    zones = spark.createDataFrame([(z, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in r + r[:1]) + "))") for z, r in enumerate(stars)], "zone int, geom string")
    got = {(r["id"], r["zone"]) for r in G.points_in_regions(_points(spark, pts, "id"), zones, "id", "zone").collect()}
    assert got == {(i, z) for i, p in enumerate(pts) for z, r in enumerate(stars) if inside(p, r)}


def test_clashing_columns(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5, "a", 9)], "id bigint, x double, y double, geom string, zone int").withColumn("_strip", F.lit(1))
    zones = spark.createDataFrame([(1, SQUARE, 3.0)], "zone int, geom string, x double")
    assert G.points_in_regions(pts, zones, "id", "zone").collect()[0].asDict() == {"id": 1, "zone": 1}
