"""The control map of two providers and claims."""

import pytest
from pyspark.sql import functions as F

from terralens.operators import overlay as O
from terralens.plans import fronts as P
from tests.test_overlay import box


def km2(layers):
    rows = O.with_area(layers).groupBy("layer").agg(F.sum("area_m2").alias("a")).collect()
    return {r["layer"]: r["a"] / 1e6 for r in rows}


def area(spark, wkt):
    return O.with_area(O.overlay(spark.createDataFrame([("x", wkt)], "l string, geom string"), "l")).agg(F.sum("area_m2")).first()[0] / 1e6


def frames(spark, baselines, effects=()):
    return spark.createDataFrame(baselines, "provider string, geom string"), spark.createDataFrame(list(effects), "effect string, geom string")


def test_two_squares(spark):
    """Half of each is agreed, the other halves are disputed and grey."""
    one = area(spark, box(37, 48, 38, 49))
    got = km2(P.build_layers(*frames(spark, [("a", box(37, 48, 38, 49)), ("b", box(37.5, 48, 38.5, 49))])))
    assert got == {"agreed": pytest.approx(one / 2, rel=1e-6), "held": pytest.approx(one / 2, rel=1e-6), "disputed": pytest.approx(one, rel=1e-6), "grey": pytest.approx(one, rel=1e-6)}


def test_effects(spark):
    """Added ground is held and not grey, cut ground is not held, pending and declared ground is grey."""
    base = [("a", box(37, 48, 38, 49)), ("b", box(37, 48, 38, 49)), ("b", box(38, 48, 38.2, 48.2)), ("a", box(39, 48, 39.003, 48.003))]
    effects = [("add", box(38, 48, 38.1, 48.2)), ("cut", box(37, 48, 37.1, 49)), ("pending", box(40, 48, 40.1, 48.1)), ("grey", box(41, 48, 41.1, 48.1))]
    got = km2(P.build_layers(*frames(spark, base, effects)))
    square, strip, small = area(spark, box(37, 48, 38, 49)), area(spark, box(37, 48, 37.1, 49)), area(spark, box(40, 48, 40.1, 48.1))
    side = area(spark, box(38, 48, 38.2, 48.2))
    assert got["agreed"] == pytest.approx(square, rel=1e-6) and got["held"] == pytest.approx(square - strip + side / 2, rel=1e-6)
    assert got["disputed"] == pytest.approx(side, rel=1e-6) and got["grey"] == pytest.approx(side / 2 + 2 * small, rel=1e-6)


def test_one_provider_and_none(spark):
    one = km2(P.build_layers(*frames(spark, [("a", box(37, 48, 38, 49)), ("a", None)])))
    assert set(one) == {"agreed", "held"} and one["agreed"] == pytest.approx(area(spark, box(37, 48, 38, 49)))
    assert set(km2(P.build_layers(*frames(spark, [], [("add", box(37, 48, 38, 49)), ("grey", box(39, 48, 40, 49))])))) == {"held", "grey"}
    assert P.build_layers(*frames(spark, [])).count() == 0


def test_claims(spark):
    rows = [("confirmed", "ru_advance", 5, 50), ("confirmed", "ru_advance", 5, 5), ("confirmed", "ua_advance", 5, 60), ("confirmed", "ua_advance", 5, 600), ("pending", "ua_advance", 20, None), ("pending", "x", 200, None), ("rejected", "ru_advance", 5, 50), (None, None, None, None)]
    c = spark.createDataFrame([("POINT (37 48)", *r) for r in rows], "geom string, status string, direction string, c bigint, r bigint").withColumns({"created_at": F.timestamp_seconds("c"), "resolved_at": F.timestamp_seconds("r")})
    assert sorted(r[0] for r in P.applied_claims(c, 10, 100).select("effect").collect()) == ["add", "cut", "pending"]


def test_polygons_cover_the_layers(spark, data):
    areas = {r["layer"]: r["km2"] for r in P.front_layers(spark, data).collect()}
    pieces = {}
    for r in P.front_polygons(spark, data).collect():
        pieces[r["layer"]] = pieces.get(r["layer"], 0) + r["km2"]
        assert r["geojson"].startswith('{"type":"Polygon"')
    assert areas and {k: pytest.approx(v, rel=1e-5, abs=0.01) for k, v in pieces.items()} == areas
