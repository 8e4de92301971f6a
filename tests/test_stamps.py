"""Timestamps: forms, zones, clock changes, and the path over record order against one sequential pass."""

import random

import pytest
from pyspark.sql import functions as F

from terralens.operators import stamps as S

KIEV, NY = "Europe/Kiev", "America/New_York"
SCHEMA = "tbl string, row_key string, raw string, source string, o1 bigint, o2 bigint, chunk bigint, home_zone string, slash_order string, dash_order string"


def one(raw, zone=None, order=None, dash=None):
    found = S.readings(raw, zone, order, dash)
    best = min(found, key=lambda x: x[2], default=None)
    return best and best[0]


def at(text):
    from datetime import datetime, timezone

    return int(datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "raw, zone, order, want",
    [
        ("2024-10-08T10:50:07Z", KIEV, None, "2024-10-08 10:50:07"),
        (" 2024-10-08 10:50:07z ", KIEV, None, "2024-10-08 10:50:07"),
        ("19/03/2025 13:28", KIEV, "dmy", "2025-03-19 11:28:00"),
        ("07/04/2024 02:47 AM", NY, "mdy", "2024-07-04 06:47:00"),
        ("07/04/2024 12:05 AM", "UTC", "mdy", "2024-07-04 00:05:00"),
        ("20240405T223901", "Europe/Moscow", None, "2024-04-05 19:39:01"),
        ("2024-03-01T08:27:41 02:00", NY, None, "2024-03-01 06:27:41"),
        ("Mon, 09 Sep 2024 17:47:20 +0300", None, None, "2024-09-09 14:47:20"),
        ("Sat, 05 Apr 2025 17:33:42 CEST", None, None, "2025-04-05 15:33:42"),
        ("2024-08-11 14:42:46 -0400", KIEV, None, "2024-08-11 18:42:46"),
        ("2024-04-23T11:05:00-04", None, None, "2024-04-23 15:05:00"),
        ("2024-11-13T01:58:17-05:00[America/New_York]", None, None, "2024-11-13 06:58:17"),
        ("1744886872535796", None, None, "2025-04-17 10:47:52"),
        ("1726817682336", None, None, "2024-09-20 07:34:42"),
        ("1737830055", None, None, "2025-01-25 18:34:15"),
        ("24.04.24, 03:26", NY, "mdy", "2024-04-24 07:26:00"),
        ("March 19, 2025 01:26 PM", "UTC", None, "2025-03-19 13:26:00"),
        ("25 stycznia 2024, godz. 18:45", "Europe/Warsaw", None, "2024-01-25 17:45:00"),
        ("24 квітня 2024, 15:29", KIEV, None, "2024-04-24 12:29:00"),
        ("18 января 2024 г. 08:28", "Europe/Moscow", None, "2024-01-18 05:28:00"),
        ("28. März 2024, 14:23 Uhr", "Europe/Berlin", None, "2024-03-28 13:23:00"),
        ("Sep 11, 2024", None, None, "2024-09-11 00:00:00"),
        ("2024-02-29", None, None, "2024-02-29 00:00:00"),
        ("2024-05-08T08:12:13.688578+05:30", None, None, "2024-05-08 02:42:13"),
        ("2024-03-01 10:00 UTC+3", KIEV, None, "2024-03-01 07:00:00"),
        ("1 Mar 2024 10:00:00 GMT-05:30", KIEV, None, "2024-03-01 15:30:00"),
        ("Tue, 01 Apr 2025 08:07:09 +0300 (EEST)", NY, None, "2025-04-01 05:07:09"),
        ("05-Sep-2024 10:00", "UTC", None, "2024-09-05 10:00:00"),
        # An hour that occurs twice is its first occurrence, a skipped one reads with the offset before.
        ("2024-10-27T03:30:00", KIEV, None, "2024-10-27 00:30:00"),
        ("2024-03-31T03:30:00", KIEV, None, "2024-03-31 01:30:00"),
        ("2024-11-03 01:30", NY, None, "2024-11-03 05:30:00"),
    ],
)
def test_forms(raw, zone, order, want):
    assert one(raw, zone, order) == at(want)


@pytest.mark.parametrize("raw", [None, "", "  ", "вчера в 18:40", "14:03", "2 hours ago", "щойно", "-", "n/a", "unknown", "????-??-??", "2024-13-40", "2024-00-00", "31.02.2024 10:15", "0000-00-00 00:00:00", "2024-02-30", "2024-01-01T25:00:00", "x" * 100_000, "9" * 50_000])
def test_no_date(raw):
    assert S.readings(raw, KIEV, "dmy", None) == []


def test_declared_order_holds_and_unknown_zone_is_utc():
    assert one("03/04/2024", "No/Where", "mdy") == at("2024-03-04 00:00:00")
    assert one("03-04-2024", None, "mdy", "dmy") == at("2024-04-03 00:00:00")
    assert S.readings("25/12/2024", None, "mdy", None) == []


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_path_equals_one_sequential_pass(spark):
    """Chunked, repartitioned and batched against ``_viterbi`` over the whole record order."""
    rng = random.Random(4)
    rows, t = [], at("2024-01-03 00:00:00")
    for i in range(400):
        t += rng.randrange(3600, 200_000)
        from datetime import datetime, timezone

        d = datetime.fromtimestamp(t, timezone.utc)
        us = rng.random() < 0.5
        form = rng.choice(["%Y-%m-%d", "%m/%d/%Y" if us else "%d/%m/%Y", "%m/%d/%Y" if us else "%d/%m/%Y", "%d.%m.%Y"]) if i % 50 > 20 else ("%m/%d/%Y" if i % 100 < 50 else "%d/%m/%Y")
        rows.append(("t", str(i), d.strftime(form), "s", t, i, t // (20 * 86400), None, None, None))
    got = {r["row_key"]: r["sec"] for r in S.normalise_stamps(_frame(spark, rows)).collect()}
    cands = [S.readings(r[2], None, None, None) for r in rows]
    want = {}
    i = 0
    prev = None
    while i < len(rows):
        if len(cands[i]) == 1:
            prev = cands[i][0][:2]
            want[str(i)] = prev[0]
            i += 1
            continue
        j = i
        while j < len(rows) and len(cands[j]) > 1:
            j += 1
        run = [([c[0] for c in cands[k]], [c[1] for c in cands[k]], [c[2] for c in cands[k]]) for k in range(i, j)]
        for k, x in zip(range(i, j), S._viterbi(prev, run, cands[j][0][:2] if j < len(rows) else None)):
            want[str(k)] = cands[k][x][0]
        i = j
    assert got == want


def test_order_is_learnt_from_neighbours(spark):
    """Without a declaration, the path takes the order that keeps time from jumping back."""
    rows = [("t", str(i), raw, "s", i, i, 0, None, None, None) for i, raw in enumerate(["2024-03-30", "04/05/2024", "04/06/2024", "2024-04-08"])]
    got = {r["row_key"]: r["sec"] for r in S.normalise_stamps(_frame(spark, rows)).collect()}
    assert got["1"] == at("2024-04-05 00:00:00") and got["2"] == at("2024-04-06 00:00:00")


def test_empty_nulls_and_repeats(spark):
    assert S.normalise_stamps(_frame(spark, [])).count() == 0
    rows = [("t", "1", "2024-01-01", "s", 0, 0, 0, None, None, None)] * 3 + [("t", None, "2024-01-01", None, 0, 0, 0, None, None, None), ("t", "2", None, "s", 0, 0, 0, None, None, None)]
    assert S.normalise_stamps(_frame(spark, rows)).count() >= 3


def test_source_tables(spark):
    news = spark.createDataFrame([(1, 7, "03/04/2024 10:00", None, "x"), (2, None, "2024-01-01", None, "x"), (3, 9, None, None, "x")], "id bigint, source_id int, published_at string, fetched_at timestamp, source string")
    clock = spark.createDataFrame([(7, "n", KIEV, "dmy"), (7, "n", KIEV, "dmy")], "source_id int, name string, home_zone string, date_order string")
    got = {r["row_key"]: r["utc"] for r in S.normalise_stamps(S.news_stamps(news, clock)).select("row_key", S.as_utc(F.col("sec")).alias("utc")).collect()}
    assert got == {"1": "2024-04-03T07:00:00Z", "2": "2024-01-01T00:00:00Z"}


def test_declared_source_is_cut_into_segments(spark):
    """A source that writes only slashed dates in its declared order has an anchor in every chunk."""
    rows = [("t", str(i), f"0{1 + i % 9}/0{1 + i % 7}/2024", "s", i, i, i // 10, None, "mdy", None) for i in range(200)]
    parsed = S.interpretations(_frame(spark, rows))
    got = {r["row_key"]: r["sec"] for r in S.choose_readings(parsed).collect()}
    assert got == {str(i): at(f"2024-0{1 + i % 9}-0{1 + i % 7} 00:00:00") for i in range(200)}
