"""Overlay of polygon layers: union, intersection, differences and their areas, without a clipping library.

The plane is cut into tiles by longitude; within a tile, vertical lines through all vertices and crossings make slabs in
which no edges cross, and crossing parity from below tells between which edges each polygon, and so each layer,
covers the slab. The result is a table of trapezoids with the layers that cover each: every set operation is then a
filter, every area a sum, and ``polygons`` turns connected trapezoids back into rings.

Scale. A tile is one task. Tiles with more than ``TILE_EDGES`` edges are split into narrower ones, as often as it takes to
come below, so dense stretches make more tasks, not larger ones.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.io import checkpointed, ship_package
from terralens.operators.graph import connected_components
from terralens.operators.spatial import WGS84_A, WGS84_E2, region_edges

TRAPEZOIDS = "tile bigint, x0 double, x1 double, lo0 double, lo1 double, hi0 double, hi1 double, layers array<string>"
#: Coordinates are compared on a grid of so many decimals of a degree.
DECIMALS = 9
#: Corners of an outline nearer than this are one.
SAME = 1e-7
#: Edges of a tile above which it is split; a tile is halved so often at most.
TILE_EDGES, MOST_HALVINGS = 2000, 12


def _crossings(x1, y1, x2, y2) -> np.ndarray:
    """Longitudes where edges cross, found block by block among those that overlap."""
    out = []
    lo, hi = np.minimum(y1, y2), np.maximum(y1, y2)
    for s in range(0, len(x1), 512):
        i = slice(s, s + 512)
        a, b = np.nonzero((x1[i, None] < x2[None]) & (x1[None] < x2[i, None]) & (lo[i, None] <= hi[None]) & (lo[None] <= hi[i, None]))
        a = a + s
        keep = a < b
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        da, db = (y2[a] - y1[a]) / (x2[a] - x1[a]), (y2[b] - y1[b]) / (x2[b] - x1[b])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (y1[b] - db * x1[b] - y1[a] + da * x1[a]) / (da - db)
        out.append(x[np.isfinite(x) & (x > np.maximum(x1[a], x1[b])) & (x < np.minimum(x2[a], x2[b]))])
    return np.round(np.concatenate(out), DECIMALS) if out else np.zeros(0)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Trapezoids of one tile."""
    columns = ["tile", "x0", "x1", "lo0", "lo1", "hi0", "hi1", "layers"]
    x1, y1, x2, y2 = (pdf[c].to_numpy(dtype=float) for c in ("x1", "y1", "x2", "y2"))
    left, right = pdf["west"].iloc[0], pdf["east"].iloc[0]
    slope = (y2 - y1) / (x2 - x1)
    a, b = np.maximum(x1, left), np.minimum(x2, right)
    ya, yb = y1 + slope * (a - x1), y1 + slope * (b - x1)
    keep = b > a
    if not keep.any():
        return pd.DataFrame(columns=columns)
    poly, names = pd.factorize(pdf["polygon"].to_numpy()[keep])
    layer_of = dict(zip(pdf["polygon"], pdf["layer"]))
    a, b, ya, yb = a[keep], b[keep], ya[keep], yb[keep]
    cuts = np.unique(np.concatenate([np.round(np.concatenate([a, b]), DECIMALS), _crossings(a, ya, b, yb), [left, right]]))
    cuts = cuts[(cuts >= left) & (cuts <= right)]
    m = (yb - ya) / (b - a)
    out = []
    for x0, x9 in zip(cuts[:-1], cuts[1:]):
        mid = (x0 + x9) / 2
        on = np.flatnonzero((a <= mid) & (b >= mid))
        if len(on) < 2:
            continue
        at = ya[on] + m[on] * (mid - a[on])
        order = on[np.argsort(at, kind="stable")]
        inside: set[int] = set()
        for e, f in zip(order[:-1], order[1:]):
            inside ^= {poly[e]}
            if inside:
                lo0, lo1, hi0, hi1 = (ya[k] + m[k] * (x - a[k]) for k in (e, f) for x in (x0, x9))
                if hi0 > lo0 or hi1 > lo1:
                    out.append((int(pdf["tile"].iloc[0]), x0, x9, lo0, lo1, hi0, hi1, sorted({layer_of[names[p]] for p in inside})))
    return pd.DataFrame(out, columns=columns)


def overlay(regions: DataFrame, layer: str, geom: str = "geom", tile_deg: float = 0.5, tile_edges: int = TILE_EDGES) -> DataFrame:
    """Trapezoids ``tile, x0, x1, lo0, lo1, hi0, hi1, layers`` of the polygons of all layers.

    ``layers`` are those with a polygon that covers the trapezoid (even-odd within a polygon, any within a layer).
    Null and empty geometries cover nothing; a null layer is left out; a polygon that a layer lists twice counts once.
    """
    ship_package(regions.sparkSession)
    r = regions.select(F.col(layer).cast("string").alias("layer"), F.col(geom).alias("geom")).where("layer IS NOT NULL AND geom IS NOT NULL").distinct().withColumn("polygon", F.xxhash64("layer", "geom"))
    edges = region_edges(r.withColumn("key", F.struct("polygon", "layer")), "key", "geom").select("key.*", "x1", "y1", "x2", "y2").where("x1 <> x2")
    swap = F.col("x1") > F.col("x2")
    edges = edges.select("polygon", "layer", *[F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    wide = edges.withColumn("_wide", F.explode(F.sequence(F.floor(F.col("x1") / tile_deg), F.floor(F.col("x2") / tile_deg))))
    halvings = F.least(F.lit(MOST_HALVINGS), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / tile_edges)))).cast("int")
    parts_of = wide.groupBy("_wide").agg(F.pow(F.lit(2.0), halvings).alias("_parts"))
    tiles = wide.join(parts_of, "_wide").withColumn("_size", tile_deg / F.col("_parts"))
    #: An edge goes into those of the parts of its wide tile that it touches.
    first, last = F.greatest(F.floor(F.col("x1") / F.col("_size")), F.col("_wide") * F.col("_parts")), F.least(F.floor(F.col("x2") / F.col("_size")), (F.col("_wide") + 1) * F.col("_parts") - 1)
    tiles = tiles.withColumn("_tile", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    tiles = tiles.withColumns({"west": F.col("_tile") * F.col("_size"), "east": (F.col("_tile") + 1) * F.col("_size")}).withColumn("tile", F.xxhash64("_wide", "_tile", "_size"))
    return tiles.select("tile", "west", "east", "polygon", "layer", "x1", "y1", "x2", "y2").groupBy("tile").applyInPandas(_tile, TRAPEZOIDS)


def area_m2(x0: Column, x1: Column, lo0: Column, lo1: Column, hi0: Column, hi1: Column) -> Column:
    """Square metres of a trapezoid on WGS84: the integral over longitude of the area from the equator, by three points."""
    e = WGS84_E2**0.5

    def from_equator(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    total = F.lit(0.0)
    for node, weight in ((-(0.6**0.5), 5 / 18), (0.0, 8 / 18), (0.6**0.5, 5 / 18)):
        t = (node + 1) / 2
        total = total + weight * (from_equator(hi0 + (hi1 - hi0) * t) - from_equator(lo0 + (lo1 - lo0) * t))
    return total * F.radians(x1 - x0) * (WGS84_A**2 / 2)


def with_area(trapezoids: DataFrame) -> DataFrame:
    """``trapezoids`` plus ``area_m2``."""
    return trapezoids.withColumn("area_m2", area_m2(*[F.col(c) for c in ("x0", "x1", "lo0", "lo1", "hi0", "hi1")]))


def parts(trapezoids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``trapezoids`` plus ``part``: the connected piece each belongs to, among those equal in ``by`` (nulls are left out).

    Pieces touch where one's right border and another's left overlap in more than a point, or where one lies on
    another within a slab. Both are equi-joins on the border's longitude.
    """
    #: Used six times below: without a checkpoint each of them plans and does all that came before.
    t = checkpointed(trapezoids.withColumn("node", F.xxhash64(*by, "x0", "x1", "lo0", "lo1", "hi0", "hi1")))
    a = t.select(*by, F.col("node").alias("a"), F.round("x1", DECIMALS).alias("x"), F.col("lo1").alias("la"), F.col("hi1").alias("ha"))
    b = t.select(*by, F.col("node").alias("b"), F.round("x0", DECIMALS).alias("x"), F.col("lo0").alias("lb"), F.col("hi0").alias("hb"))
    across = a.join(b, [*by, "x"]).where("least(ha, hb) - greatest(la, lb) > 1e-9").select("a", "b")
    upper = t.select(*by, F.col("node").alias("b"), "x0", "x1", F.round("lo0", DECIMALS).alias("y0"), F.round("lo1", DECIMALS).alias("y1"))
    lower = t.select(*by, F.col("node").alias("a"), "x0", "x1", F.round("hi0", DECIMALS).alias("y0"), F.round("hi1", DECIMALS).alias("y1"))
    stacked = lower.join(upper, [*by, "x0", "x1", "y0", "y1"]).select("a", "b")
    found = connected_components(t, across.union(stacked)).withColumnRenamed("component", "part")
    return t.join(found, "node").drop("node")


def without_slivers(trapezoids: DataFrame, at_least_m2: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The trapezoids of connected pieces of at least the given area, with ``part`` and ``area_m2``."""
    p = with_area(parts(trapezoids, by))
    big = p.groupBy("part").agg(F.sum("area_m2").alias("_sum")).where(F.col("_sum") >= at_least_m2).select("part")
    return p.join(big, "part", "left_semi")


def _snapped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` rounded so that values of one ``x`` that differ by rounding alone are equal."""
    order = np.lexsort((y, x))
    out = np.round(y, DECIMALS)
    for i, k in zip(order[:-1], order[1:]):
        if x[i] == x[k] and y[k] - y[i] < 1.5 * 10.0**-DECIMALS:
            out[k] = out[i]
    return out


def rings_of(trapezoids: pd.DataFrame) -> list[list[tuple[float, float]]]:
    """Closed rings round the union of trapezoids that don't overlap: outer ones against the clock, holes with it.

    Borders that two trapezoids share cancel; what is left is followed from edge to edge, turning as far to the left
    as possible where rings touch in a point. Corners on a straight line are left out.
    """
    x0, x1 = (np.round(trapezoids[c].to_numpy(float), DECIMALS) for c in ("x0", "x1"))
    n = len(x0)
    xs = np.concatenate([x0, x1, x0, x1])
    ys = _snapped(xs, np.concatenate([trapezoids[c].to_numpy(float) for c in ("lo0", "lo1", "hi0", "hi1")]))
    lo0, lo1, hi0, hi1 = ys[:n], ys[n : 2 * n], ys[2 * n : 3 * n], ys[3 * n :]
    edges: dict[tuple, int] = {}

    def add(a: tuple, b: tuple, k: int = 1) -> None:
        if a != b and (k := k + edges.pop((a, b), 0) - edges.pop((b, a), 0)):
            edges[(a, b) if k > 0 else (b, a)] = abs(k)

    borders: dict[float, list[tuple[float, float, int]]] = {}
    for i in range(n):
        add((x0[i], lo0[i]), (x1[i], lo1[i]))
        add((x1[i], hi1[i]), (x0[i], hi0[i]))
        borders.setdefault(x1[i], []).append((lo1[i], hi1[i], 1))
        borders.setdefault(x0[i], []).append((lo0[i], hi0[i], -1))
    for x, spans in borders.items():
        cuts = sorted({y for lo, hi, _ in spans for y in (lo, hi)})
        steps = dict.fromkeys(cuts, 0)
        for lo, hi, k in spans:
            steps[lo] += k
            steps[hi] -= k
        net = 0
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            net += steps[lo]
            #: Crossings are rounded, so two trapezoids may overlap by a hair on a border: it counts twice there.
            if net > 0:
                add((x, lo), (x, hi), net)
            elif net < 0:
                add((x, hi), (x, lo), -net)
    after: dict[tuple, list[tuple]] = {}
    for (a, b), k in edges.items():
        after.setdefault(a, []).extend([b] * k)
    rings = []
    while after:
        start = min(after)
        ring, at, came = [start], start, None
        while True:
            options = after[at]
            k = 0
            if came is not None and len(options) > 1:
                angle = np.arctan2(at[1] - came[1], at[0] - came[0])
                turn = [(np.arctan2(b[1] - at[1], b[0] - at[0]) - angle + np.pi) % (2 * np.pi) for b in options]
                k = int(np.argmax(turn))
            came, at = at, options.pop(k)
            if not options:
                del after[came]
            ring.append(at)
            if at == start:
                break
        rings.append(_straightened(ring))
    return [r for r in rings if len(r) > 3]


def _straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed ring without repeated corners and those that lie on a straight line."""
    pts: list[tuple[float, float]] = []
    for p in ring[:-1]:
        #: Two edges meet at a rounded longitude, so a corner may come twice, a hair apart.
        if not pts or max(abs(p[0] - pts[-1][0]), abs(p[1] - pts[-1][1])) > SAME:
            pts.append(p)
    while len(pts) > 1 and max(abs(pts[0][0] - pts[-1][0]), abs(pts[0][1] - pts[-1][1])) <= SAME:
        pts.pop()
    changed = True
    while changed and len(pts) > 3:
        kept: list[tuple[float, float]] = []
        for i, p in enumerate(pts):
            a, b = (kept[-1] if kept else pts[-1]), pts[(i + 1) % len(pts)]
            length = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1e-12)
            if abs((b[0] - a[0]) * (p[1] - a[1]) - (p[0] - a[0]) * (b[1] - a[1])) / length > 2 * 10.0**-DECIMALS:
                kept.append(p)
        changed, pts = len(kept) < len(pts), kept
    return [*pts, pts[0]] if pts else []


def _ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:])) / 2


def polygons(trapezoids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, part, geom, area_m2``: the connected pieces of trapezoids (of each group ``by``) that don't overlap, as valid polygons in well-known text.

    Each piece is one outer ring against the clock and its holes. A piece is one row, so it is put together in one task.
    """
    ship_package(trapezoids.sparkSession)
    p = with_area(parts(trapezoids, by) if "part" not in trapezoids.columns else trapezoids)
    fields = trapezoids.select(*by).schema.fields
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "part bigint, geom string, area_m2 double"])

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = sorted(rings_of(pdf), key=_ring_area, reverse=True)
        text = ", ".join("(" + ", ".join(f"{x:.{DECIMALS}f} {y:.{DECIMALS}f}" for x, y in r) + ")" for r in rings)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), pdf["part"].iloc[0], f"POLYGON ({text})" if rings else "POLYGON EMPTY", float(pdf["area_m2"].sum())]], columns=[*by, "part", "geom", "area_m2"])

    return p.groupBy(*by, "part").applyInPandas(outline, schema)


def geojson(geom: Column, digits: int = 5) -> Column:
    """GeoJSON geometry of a point, polygon or multipolygon in well-known text, coordinates rounded; null for other text."""
    num = lambda v: F.round(v.try_cast("double"), digits).cast("string")
    position = lambda p: F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.filter(F.split(F.trim(p), r"\s+"), lambda c: c != ""), 1, 2), num), ","), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.split(F.regexp_replace(r, r"[()]", ""), ","), position), ","), F.lit("]"))
    polygon = lambda t: F.concat(F.lit("["), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"\([^()]+\)"), F.lit(0)), ring), ","), F.lit("]"))
    body = F.regexp_extract(geom, r"(?is)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*[a-z]+\s*Z?\s*(\(.*\))\s*$", 1)
    kind = F.upper(F.regexp_extract(geom, r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(POINT|POLYGON|MULTIPOLYGON)\b", 1))
    members = F.regexp_extract_all(body, F.lit(r"\(\s*\([^()]+\)(?:\s*,\s*\([^()]+\))*\s*\)"), F.lit(0))
    text = lambda name, c: F.concat(F.lit(f'{{"type":"{name}","coordinates":'), c, F.lit("}"))
    return (
        F.when((kind == "POINT") & (body != ""), text("Point", position(F.regexp_replace(body, r"[()]", ""))))
        .when((kind == "POLYGON") & (body != ""), text("Polygon", polygon(body)))
        .when((kind == "MULTIPOLYGON") & (body != ""), text("MultiPolygon", F.concat(F.lit("["), F.array_join(F.transform(members, polygon), ","), F.lit("]"))))
    )


def buffer_wkt(lon: Column, lat: Column, radius_m: float, corners: int = 32) -> Column:
    """A polygon of ``corners`` corners round a point, as well-known text, by the local radii of the ellipsoid."""
    s2 = F.pow(F.sin(F.radians(lat)), 2)
    w = F.sqrt(1 - WGS84_E2 * s2)
    north = radius_m / (WGS84_A * (1 - WGS84_E2) / (w * w * w))
    east = radius_m / (WGS84_A / w * F.cos(F.radians(lat)))
    point = lambda k: F.concat_ws(" ", (lon + F.degrees(east * F.cos(F.lit(2 * np.pi) * k / corners))).cast("string"), (lat + F.degrees(north * F.sin(F.lit(2 * np.pi) * k / corners))).cast("string"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: point(F.pmod(k, F.lit(corners))))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))")))


def simplified(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A closed ring with fewer points, none of those left out further than ``tolerance`` from it; at least a triangle."""
    if len(ring) <= 4:
        return ring
    pts = np.array(ring)
    far = int(np.argmax(((pts - pts[0]) ** 2).sum(axis=1)))
    keep = {0, far, len(pts) - 1}
    stack = [(0, far), (far, len(pts) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, p = pts[j] - pts[i], pts[i + 1 : j] - pts[i]
        t = np.clip((p @ d) / max(d @ d, 1e-300), 0, 1)[:, None]
        dist = np.sqrt(((p - t * d) ** 2).sum(axis=1))
        k = int(np.argmax(dist))
        if dist[k] > tolerance or (len(keep) < 4 and dist[k] > 0):
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return [ring[i] for i in sorted(keep)]


def simplify_wkt(geom: Column, tolerance: float) -> Column:
    """Well-known text of a polygon with each ring simplified; other text stays as it is."""
    def one(text: str | None) -> str | None:
        if text is None:
            return None

        def ring(m: re.Match) -> str:
            try:
                pts = [tuple(map(float, p.split()[:2])) for p in m[1].split(",")]
            except ValueError:
                return m[0]
            return "(" + ", ".join(f"{x!r} {y!r}" for x, y in simplified(pts, tolerance)) + ")" if all(len(p) == 2 for p in pts) else m[0]

        return re.sub(r"\(([^()]+)\)", ring, text)

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(geom)
