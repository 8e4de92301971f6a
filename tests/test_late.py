"""The event-period by arrival-period triangle."""

from pyspark.sql import functions as F

from terralens.operators import late
from terralens.plans import problems

DAY0 = 1704067200  # 2024-01-01


def _records(spark, rows):
    return spark.createDataFrame(rows, "id bigint, e double, a double, outcome string")


def test_outcomes_and_bounds(spark):
    end = DAY0 + 86400
    rows = [(1, DAY0 + 5.0, end + 6 * 3600.0), (2, DAY0 + 5.0, end + 6 * 3600 + 0.5), (3, DAY0 + 5.0, end + 72 * 3600.0), (4, DAY0 + 5.0, end + 72 * 3600 + 1.0), (5, DAY0 + 5.0, DAY0 - 100.0), (6, None, 1.0), (7, 1.0, None)]
    placed = late.place(_records(spark, [(*r, "clash") for r in rows]), "e", "a")
    got = {r["id"]: (r["event_day"], r["outcome"]) for r in late.with_outcome(placed, late.triangle(placed)).collect()}
    assert got == {1: ("2024-01-01", "on_time"), 2: ("2024-01-01", "late"), 3: ("2024-01-01", "late"), 4: ("2024-01-01", "cut"), 5: ("2024-01-01", "on_time")}


def test_outcome_follows_the_grace_and_the_cut_off(spark):
    """The same records with another grace and cut-off: the triangle decides, not the record."""
    end = DAY0 + 86400
    placed = late.place(_records(spark, [(h, DAY0 + 5.0, end + h * 3600.0, None) for h in (1, 5, 30, 100)]), "e", "a")
    outcomes = lambda **k: [r["outcome"] for r in late.with_outcome(placed, late.triangle(placed, **k)).orderBy("id").collect()]
    assert outcomes() == ["on_time", "on_time", "late", "cut"] and outcomes(grace_h=0, cutoff_h=24) == ["late", "late", "cut", "cut"] and outcomes(grace_h=200, cutoff_h=300) == ["on_time"] * 4


def test_late_only_days_and_null_keys(spark):
    """A day of which nothing came in time is published as 0; null keys are a group of their own."""
    rows = [(1, DAY0 + 1.0, DAY0 + 86400 + 30 * 3600.0, None), (1, DAY0 + 1.0, DAY0 + 86400 + 30 * 3600.0, None), (2, DAY0 + 1.0, DAY0 + 5.0, "x")]
    placed = late.place(_records(spark, rows), "e", "a").withColumnRenamed("outcome", "k")
    cells = late.triangle(placed, ("k",))
    assert {(r["k"], r["published"], r["total"], r["outcome"]) for r in cells.collect()} == {(None, 0, 2, "late"), ("x", 1, 1, "on_time")}
    assert sorted((r["id"], r["outcome"]) for r in late.with_outcome(placed, cells, ("k",)).collect()) == [(1, "late"), (1, "late"), (2, "on_time")]


def test_revisions_accumulate(spark):
    end = DAY0 + 86400
    rows = [(i, DAY0 + 1.0, end + h * 3600.0, None) for i, h in enumerate([0, 0, 3, 10, 10, 80, 90])]
    cells = late.triangle(late.place(_records(spark, rows), "e", "a")).orderBy("lag_h").collect()
    assert [(c["lag_h"], c["arrived"], c["revision"], c["total"], c["beyond"]) for c in cells] == [(0, 2, 1, 2, 0), (3, 1, 2, 3, 0), (10, 2, 3, 5, 0), (80, 1, 4, 5, 1), (90, 1, 5, 5, 2)]


def test_empty(spark):
    placed = late.place(_records(spark, []), "e", "a")
    assert late.triangle(placed).count() == 0 and late.with_outcome(placed, late.triangle(placed)).count() == 0


def test_revisions_count_events_dated_by_their_item(spark, data):
    """The late events and those cut off in all revisions are those of ``p4_found``, null ``occurred_at`` included."""
    got = {(r[0], r[1]): r[2] for r in problems.p4_all_revisions(spark, data).where("outcome <> 'on_time'").groupBy("event_day", "outcome").agg(F.sum("arrived")).collect()}
    assert got and got == {(r[0], r[1]): r[2] for r in problems.p4_found(spark, data).groupBy("event_day", "outcome").count().collect()}
