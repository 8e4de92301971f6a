"""Space-time clusters against brute force."""

import random

from terralens.operators import clusters as C

SCHEMA = "id bigint, kind string, x double, y double, at bigint, cluster int, links string"


def brute(rows, radius, gap):
    import math

    rows = [r for r in dict.fromkeys(rows) if None not in r[:5]]
    near = lambda a, b: a[1] == b[1] and abs(a[4] - b[4]) <= gap and math.hypot((a[2] - b[2]) * 111320 * math.cos(math.radians((a[3] + b[3]) / 2)), (a[3] - b[3]) * 111320) <= radius
    links = {i: [j for j in range(len(rows)) if j != i and near(rows[i], rows[j])] for i in range(len(rows))}
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        seen |= group
        for j in group:
            out[rows[j][0]] = (min(rows[k][0] for k in group), len(group), len(links[j]))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    places = [(30 + rng.random() * 0.2, 48 + rng.random() * 0.2) for _ in range(25)]
    rows = [(i, rng.choice("ab"), *rng.choice(places), rng.randrange(0, 20 * 86400), 1, "x") for i in range(400)]
    rows += [(1000 + i, "a", 31.0, 49.0, i * 3600, 1, "x") for i in range(150)] + [(2000, None, 1.0, 1.0, 1, 1, "x"), (2001, "a", None, 1.0, 1, 1, "x"), (2002, "a", 1.0, 1.0, None, 1, "x")] + [(5, *rows[5][1:])]
    got = {r["id"]: (r["cluster"], r["members"], r["links"]) for r in C.space_time_clusters(spark.createDataFrame(rows, SCHEMA), "id", "kind", "at", 3000.0, 86400).collect()}
    assert got == brute(rows, 3000.0, 86400)


def test_empty(spark):
    assert C.space_time_clusters(spark.createDataFrame([], SCHEMA), "id", "kind", "at", 3000.0, 86400).count() == 0
