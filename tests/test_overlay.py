"""Overlays: two squares, identities on random stars, parts, areas, buffers, components."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralens.operators import graph, overlay as O


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def areas(spark, rows, **kw):
    df = spark.createDataFrame(rows, "l string, geom string")
    t = O.with_area(O.overlay(df, "l", **kw))
    return {tuple(r["layers"]): r["a"] for r in t.groupBy("layers").agg(F.sum("area_m2").alias("a")).collect()}


def plane(spark, rows, **kw):
    t = O.overlay(spark.createDataFrame(rows, "l string, geom string"), "l", **kw)
    return {tuple(r["layers"]): r["a"] for r in t.groupBy("layers").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("hi0") - F.col("lo0") + F.col("hi1") - F.col("lo1")) / 2).alias("a")).collect()}


def test_two_squares(spark):
    got = plane(spark, [("a", box(37, 48, 38, 49)), ("b", box(37.5, 48, 38.5, 49)), ("b", None), (None, box(0, 0, 1, 1)), ("a", "")])
    assert got == {("a",): pytest.approx(0.5), ("a", "b"): pytest.approx(0.5), ("b",): pytest.approx(0.5)}
    assert O.overlay(spark.createDataFrame([], "l string, geom string"), "l").count() == 0


def test_overlapping_polygons_of_a_layer_unite_and_holes_stay_open(spark):
    got = plane(spark, [("a", box(0, 0, 2, 2)), ("a", box(1, 1, 3, 3)), ("b", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))")])
    assert got[("a", "b")] == pytest.approx(3) and got[("a",)] == pytest.approx(4) and got[("b",)] == pytest.approx(9)


def test_identities_on_stars(spark):
    rng = random.Random(7)

    def star(cx, cy, n=60):
        pts = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(0.3, 1.2)]]
        shoelace = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2
        return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in pts + pts[:1]) + "))", shoelace

    (a, sa), (b, sb) = star(30, 48), star(30.4, 48.3)
    one, two = plane(spark, [("a", a), ("b", b)]), plane(spark, [("a", a), ("b", b)], tile_deg=0.13)
    for got in (one, two):
        assert got[("a",)] + got[("a", "b")] == pytest.approx(sa, rel=1e-6) and got[("b",)] + got[("a", "b")] == pytest.approx(sb, rel=1e-6)


def test_area_on_the_ellipsoid(spark):
    """A degree of longitude from the equator to the pole is 1/720 of the ellipsoid's surface."""
    assert areas(spark, [("a", box(10, 0, 11, 90))], tile_deg=1.0)[("a",)] == pytest.approx(510065621724088.0 / 720, rel=2e-2)
    small = areas(spark, [("a", box(37, 48, 37.01, 48.01))])[("a",)]
    assert small == pytest.approx(1112.0 * 746.0, rel=2e-3)


def test_parts_and_slivers(spark):
    df = spark.createDataFrame([("a", box(0, 0, 2, 1)), ("a", box(1.5, 0.5, 3, 3)), ("a", box(5, 5, 5.001, 5.001)), ("a", box(7, 7, 8, 8))], "l string, geom string")
    p = O.parts(O.overlay(df, "l"))
    assert p.select("part").distinct().count() == 3
    assert O.without_slivers(O.overlay(df, "l"), 1e6).select("part").distinct().count() == 2


def test_buffer(spark):
    df = spark.createDataFrame([(37.0, 48.0), (None, 1.0)], "x double, y double").select(F.lit("a").alias("l"), O.buffer_wkt(F.col("x"), F.col("y"), 1500.0).alias("geom"))
    a = O.with_area(O.overlay(df, "l")).agg(F.sum("area_m2")).first()[0]
    assert a == pytest.approx(math.pi * 1500**2, rel=0.02)


def test_simplified(spark):
    ring = [(math.cos(k / 100 * 2 * math.pi), math.sin(k / 100 * 2 * math.pi)) for k in range(100)] + [(1.0, 0.0)]
    s = O.simplified(ring, 0.05)
    assert s[0] == s[-1] == ring[0] and 6 < len(s) < 40
    df = spark.createDataFrame([(box(0, 0, 1, 1),), (None,), ("x",), ("POLYGON ((0 0, 1 0, 1 0.5, 1 1, 0 1, 0 0))",)], "g string")
    got = [r[0] for r in df.select(O.simplify_wkt(F.col("g"), 0.1)).collect()]
    assert got[1] is None and got[2] == "x" and got[3].count(",") == 4


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5), (None, 3), (7, None), (200, 201), (201, 200)]
    rng.shuffle(links)
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 40), *range(100, 161), 200, 201, 300]], "node bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: (1 if i < 40 else 100 if i < 161 else 200 if i < 300 else 300) for i in got} and len(got) == 103
    assert graph.connected_components(nodes.limit(0), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:])) / 2


def rings(wkt):
    import re

    return [[tuple(map(float, p.split())) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", wkt)]


def test_polygons_of_squares_with_a_hole_and_touching_corners(spark):
    rows = [("a", box(0, 0, 2, 2)), ("a", box(1, 1, 3, 3)), ("a", box(5, 5, 6, 6)), ("a", box(6, 6, 7, 7)), ("h", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))")]
    df = spark.createDataFrame(rows, "l string, geom string")
    got = {}
    for name in ("a", "h"):
        t = O.overlay(df, "l").where(F.array_contains("layers", name)).drop("layers")
        got[name] = [rings(r["geom"]) for r in O.polygons(t).collect()]
    assert sorted(round(sum(map(shoelace, p)), 6) for p in got["a"]) == [1, 1, 7] and all(len(p) == 1 and len(p[0]) in (5, 9) for p in got["a"])
    assert [sorted(round(shoelace(r), 6) for r in p) for p in got["h"]] == [[-4, 16]]
    assert all(r[0] == r[-1] for p in got["a"] + got["h"] for r in p)


def test_rings_of_trapezoids_that_overlap_by_a_hair():
    """Borders where a rounded crossing lets two trapezoids overlap, on one side or on both."""
    two = [(0.0, 1.0, 0.0, 0.0, 1.0, 1.00000002), (0.0, 1.0, 1.5, 1.0, 2.0, 2.0)]
    for rows in (two, [(1 - x1, 1 - x0, lo1, lo0, hi1, hi0) for x0, x1, lo0, lo1, hi0, hi1 in two], [*two, (1.0, 2.0, 0.0, 0.0, 2.0, 2.0)]):
        got = O.rings_of(pd.DataFrame(rows, columns=["x0", "x1", "lo0", "lo1", "hi0", "hi1"]))
        assert sum(map(O._ring_area, got)) == pytest.approx(1.75 + 2 * (len(rows) - 2), abs=1e-6)


def test_polygons_keep_the_area_of_random_overlays(spark):
    rng = random.Random(3)

    def star(cx, cy, n=40):
        pts = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(0.3, 1.1)]]
        return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in pts + pts[:1]) + "))"

    df = spark.createDataFrame([("a", star(30, 48)), ("b", star(30.5, 48.2)), ("a", star(31, 48.9))], "l string, geom string")
    t = O.overlay(df, "l", tile_edges=20)
    for wanted in (F.size("layers") == 2, F.size("layers") == 1, F.lit(True)):
        some = t.where(wanted).drop("layers")
        plain = some.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("hi0") - F.col("lo0") + F.col("hi1") - F.col("lo1")) / 2)).first()[0]
        found = O.polygons(some).collect()
        assert sum(shoelace(r) for p in found for r in rings(p["geom"])) == pytest.approx(plain, rel=1e-6)
        #: Valid: read again and laid over, the pieces cover the same area.
        again = O.overlay(spark.createDataFrame([("x", p["geom"]) for p in found], "l string, geom string"), "l")
        assert again.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("hi0") - F.col("lo0") + F.col("hi1") - F.col("lo1")) / 2)).first()[0] == pytest.approx(plain, rel=1e-6)


def test_splitting_dense_tiles_changes_nothing(spark):
    rows = [("a", box(30, 48, 30.4, 48.4)), ("b", box(30.1, 48.1, 30.7, 48.2))]
    assert plane(spark, rows, tile_edges=1) == {k: pytest.approx(v) for k, v in plane(spark, rows).items()}


def test_the_same_polygon_twice_counts_once(spark):
    assert plane(spark, [("a", box(0, 0, 1, 1))] * 2) == {("a",): pytest.approx(1)}


def test_geojson(spark):
    cases = {"POINT (37.1234567 48)": '{"type":"Point","coordinates":[37.12346,48.0]}', "SRID=4326;POINT(1 2)": '{"type":"Point","coordinates":[1.0,2.0]}', "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))": '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]],[[0.1,0.1],[0.2,0.1],[0.2,0.2],[0.1,0.1]]]}', "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,5.0]]]]}', "LINESTRING (0 0, 1 1)": None, "": None, None: None, "POINT EMPTY": None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "g string").select("g", O.geojson(F.col("g"))).collect()} == cases
