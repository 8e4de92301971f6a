"""What the plans must look like: no product of two tables, filters and columns that reach the scan."""

import re

import pytest

from terralens.plans import feeds, problems, review, serving

CASES = [(m, k) for m in (problems, serving, feeds, review) for k in m.QUERIES]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module, name", CASES, ids=[k for _, k in CASES])
def test_no_product(spark, data, module, name):
    text = plan(module.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "query, pushed, read",
    [
        (serving.events_points_window, ("EqualTo(visible,true)", "GreaterThanOrEqual(occurred_at", "In(event_type", "GreaterThanOrEqual(lon"), 8),
        (serving.events_grid_clusters, ("EqualTo(visible,true)", "IsNotNull(lon)"), 6),
        (serving.news_events_nested, ("EqualTo(visible,true)",), 4),
        (serving.timeline_bounds, ("EqualTo(visible,true)", "IsNotNull(occurred_at)"), 5),
        (serving.modal_place, ("IsNotNull(gazetteer_id)", "IsNotNull(place_name_raw)"), 3),
        (feeds.placeable_pending, ("IsNull(geom)", "IsNull(gazetteer_id)"), 4),
    ],
    ids=lambda x: getattr(x, "__name__", None),
)
def test_filters_and_columns_reach_the_scan(spark, data, query, pushed, read):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    scans = [line for line in plan(query(spark, data)).split("\n") if "FileScan" in line and "extracted_events" in line]
    assert scans
    for line in scans:
        assert all(p in line for p in pushed), line
        assert len(re.search(r"ReadSchema: struct<(.*?)>\s*$", line)[1].split(",")) <= read, line
