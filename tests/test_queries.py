"""Every query of the core: those with SQL give DuckDB's rows, the others rows that hold by themselves."""

import pytest

from terralens.plans import analysis, feeds, fronts, problems, review, serving
from tests.queries import assert_same

MODULES = (problems, serving, feeds, fronts, review, analysis)
CASES = [(m, k) for m in MODULES for k in m.QUERIES]
#: What a query without SQL must give on the smallest tables.
HOLDS = {
    "p2_readings": lambda rows: sum(r["stamps"] for r in rows) > 100 and all(r["open"] <= r["readings"] for r in rows),
    "overlay_parts": lambda rows: len(rows) > 5 and all(r["km2"] >= 0.5 and r["west"] < r["east"] for r in rows),
    "zone_outlines": lambda rows: len(rows) == 42 and all(r["geom"].upper().startswith(("POLYGON", "MULTIPOLYGON", "SRID")) for r in rows),
    "hinted_places": lambda rows: len(rows) > 20 and all(0.55 <= r["score"] <= 1 and r["resolution"] in ("hinted", "countrywide", "fallback") for r in rows) and not any(r["ambiguous"] and r["resolution"] != "countrywide" for r in rows),
    "review_queue": lambda rows: len(rows) > 5 and all(1 <= r["rank"] <= 5 for r in rows) and len({(r["id"], r["rank"]) for r in rows}) == len(rows),
    "front_layers": lambda rows: {r["layer"] for r in rows} >= {"agreed", "disputed", "held", "grey"},
    "front_polygons": lambda rows: len(rows) > 5 and all(r["km2"] >= 0 for r in rows),
}


@pytest.mark.parametrize("module, name", CASES, ids=[k for _, k in CASES])
def test_query(spark, data, module, name):
    if name in module.ORACLES:
        assert_same(spark, data, module.QUERIES[name], module.ORACLES[name])
    else:
        assert HOLDS[name](module.QUERIES[name](spark, data).collect())
