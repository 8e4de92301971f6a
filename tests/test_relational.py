"""Relational operators against brute force: chunks of time, ranks, packs, merged maps, feeds."""

import math
import random

from pyspark.sql import functions as F

from terralens.operators import relational as R
from terralens.operators import spatial as G


def test_as_of_across_chunks(spark):
    """Versions long before an instant are carried over many chunks; null keys meet null keys."""
    rng = random.Random(6)
    versions = [(rng.choice(["a", "b", None]), rng.randrange(-500, 3000), i) for i in range(120)] + [("c", None, 7)]
    asked = [(rng.choice(["a", "b", None, "d"]), rng.randrange(-900, 9000)) for _ in range(200)] + [("a", None)]
    v, q = spark.createDataFrame(versions, "k string, t bigint, v int"), spark.createDataFrame(asked, "k string, at bigint")
    want = {}
    for k, at in set(asked):
        if at is not None:
            best = max(((t, n) for kk, t, n in versions if kk == k and t is not None and t <= at), default=(None, None))
            want[k, at] = best
    for chunk in (1, 37, 10**6):
        got = {(r["k"], r["at"]): (r["t"], r["v"]) for r in R.as_of(v, q, ["k"], "t", "at", chunk).collect()}
        assert got == want
    assert R.as_of(v.limit(0), q, ["k"], "t", "at").where("v IS NOT NULL").count() == 0 and R.as_of(v, q.limit(0), ["k"], "t", "at").count() == 0


def test_sessions_across_chunks(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(0, 4000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, at bigint")
    want = {}
    for k in ("a", "b", None):
        n, last = 1, None
        for at in sorted({at for _, kk, at in rows if kk == k and at is not None}):
            n += last is not None and at - last > 30
            last = at
            want |= {i: n for i, kk, a in rows if kk == k and a == at}
    want |= {i: None for i, _, a in rows if a is None}
    for chunk in (5, 100, 10**6):
        assert {r["id"]: r["session"] for r in R.sessions(df, ["k"], "at", 30, chunk).collect()} == want
    assert R.sessions(df.limit(0), ["k"], "at", 30).count() == 0


def test_percentile_disc(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-300, 300)])) for _ in range(400)] + [("one", 5)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    for q in (0.01, 0.5, 1.0):
        want = {k: sorted(v for kk, v in rows if kk == k and v is not None)[max(1, math.ceil(q * sum(kk == k and v is not None for kk, v in rows) - 1e-9)) - 1] for k in ("a", "b", None, "one")}
        for bucket in (1, 50, 10**6):
            assert {r["k"]: r["v"] for r in R.percentile_disc(df, ["k"], "v", q, bucket).collect()} == want


def test_round_robin_and_packs(spark):
    df = spark.createDataFrame([(i, "p", "xyz"[i % 3] if i > 5 else "x", i) for i in range(30)], "id int, place string, lane string, rank int")
    got = [(r["pick"], r["lane"], r["turn"]) for r in R.round_robin(df, ["place"], "lane", [F.asc("rank")], 5).orderBy("pick").collect()]
    assert got == [(1, "x", 1), (2, "y", 1), (3, "z", 1), (4, "x", 2), (5, "y", 2)]
    sizes = spark.createDataFrame([("a", 1, 900), ("a", 2, 5), ("b", 1, 60), ("b", 2, 30), ("b", 3, 30)], "k string, n int, size int")
    got = {(r["k"], r["n"]): (r["used"], r["granted"]) for r in R.prefix_pack(sizes, ["k"], [F.asc("n")], F.col("size"), 100, 200).collect()}
    assert got == {("a", 1): (900, 200), ("b", 1): (60, 60), ("b", 2): (90, 30)}


def test_maps_merge(spark):
    old = spark.createDataFrame([(1, "n", {"a": "1", "b": "2"}), (2, "m", None), (3, "k", {"a": "1"})], "id int, name string, meta map<string,string>")
    new = spark.createDataFrame([(1, "x", {"b": "9", "c": "3"}), (2, "y", {"z": "0"}), (4, "new", {"q": "1"})], "id int, name string, meta map<string,string>")
    got = {r["id"]: (r["name"], r["meta"]) for r in R.upsert_maps(old, new, ["id"], ["meta"], ["name"]).collect()}
    assert got == {1: ("n", {"a": "1", "b": "9", "c": "3"}), 2: ("m", {"z": "0"}), 3: ("k", {"a": "1"}), 4: ("new", {"q": "1"})}


def test_feeds(spark):
    a, b = spark.createDataFrame([(1, 50), (2, 40)], "id bigint, t bigint"), spark.createDataFrame([(9, 50), (8, 45), (7, 10)], "id bigint, t bigint")
    assert [r["id"] for r in R.merged_feed(a, b, "t", "id", 4).orderBy(F.desc("t"), "feed").collect()] == [1, 9, 8, 2]
    latest = spark.createDataFrame([(1, 50), (3, 60), (4, 50), (5, 49)], "id bigint, t bigint")
    assert {r["id"] for r in R.unseen(latest, a, "t", "id").collect()} == {3, 4}
    assert {r["id"] for r in R.unseen(latest, a.limit(0), "t", "id").collect()} == {1, 3, 4, 5}


def test_distance_to_borders(spark):
    rng = random.Random(5)
    ring = [(30.0, 48.0), (31.0, 48.0), (31.0, 48.7), (30.2, 48.9), (30.0, 48.0)]
    zones = spark.createDataFrame([(1, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))"), (2, None)], "zone int, geom string")
    pts = [(i, 29.7 + 1.7 * rng.random(), 47.7 + 1.5 * rng.random()) for i in range(120)]
    m, n = math.pi / 180 * G.WGS84_A * (1 - G.WGS84_E2), math.pi / 180 * G.WGS84_A

    def dist(x, y):
        w = math.sqrt(1 - G.WGS84_E2 * math.sin(math.radians(y)) ** 2)
        ky, kx = m / w**3, n / w * math.cos(math.radians(y))
        best = 1e18
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            ux, uy, px, py = (x2 - x1) * kx, (y2 - y1) * ky, (x - x1) * kx, (y - y1) * ky
            t = min(1, max(0, (ux * px + uy * py) / (ux * ux + uy * uy)))
            best = min(best, math.hypot(px - t * ux, py - t * uy))
        return best

    got = {r["id"]: r["dist_m"] for r in G.boundary_m(spark.createDataFrame(pts, "id int, x double, y double"), zones, "id", "zone", 10000.0).collect()}
    want = {i: d for i, x, y in pts if (d := dist(x, y)) <= 10000}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 for i in want) and len(want) > 20


def test_keys_in_distance_joins_and_places(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice("ab"), 30 + rng.random() * 0.1, 48 + rng.random() * 0.1) for i in range(80)]
    df = spark.createDataFrame(pts, "id bigint, k string, x double, y double")
    a, b = df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b")
    plain = {(r["a"], r["b"]) for r in G.distance_join(a, b, "a", "b", 3000.0).collect()}
    kind = {i: k for i, k, _, _ in pts}
    assert {(r["a"], r["b"]) for r in G.distance_join(a, b, "a", "b", 3000.0, on=("k",)).collect()} == {(i, j) for i, j in plain if kind[i] == kind[j]}
    assert {(r["a"], r["b"]) for r in G.distance_join(a, b, "a", "b", 3000.0, on=("k",), ordered=True).collect()} == {(i, j) for i, j in plain if kind[i] == kind[j] and i < j}
    assert G.near_places(df, df, 3000.0).count() == len(plain)
    best = {r["a"]: r["b"] for r in G.nearest_join(a, b, "a", "b", 3000.0, on=("k",)).collect()}
    assert best == {i: i for i in kind}
