"""Repeated lines of a source against brute force."""

import re
from collections import Counter, defaultdict
from datetime import datetime

from terralens.io import table
from terralens.llm import boilerplate as B

SCHEMA = "source_id int, id bigint, body string, fetched_at timestamp, line string, rows int"


def norm(line):
    return re.sub(r"\d+", "0", re.sub(r"[ \t ]+", " ", line.lower())).strip(" ")


def frame(spark, bodies):
    return spark.createDataFrame([(s, i, b, datetime(2024, 1, 1 + i % 20), "clash", 1) for i, (s, b) in enumerate(bodies)], SCHEMA)


def places(df, **limits):
    return {(r["id"], r["line_no"]) for r in B.boilerplate_places(df, "source_id", "id", "body", "fetched_at", **limits).collect()}


def test_equals_brute_force(spark, data):
    df = table(spark, data, "news_items")
    rows = df.select("id", "source_id", "body").collect()
    total, count = Counter(r["source_id"] for r in rows), defaultdict(set)
    for r in rows:
        for line in (r["body"] or "").split("\n"):
            count[r["source_id"], norm(line)].add(r["id"])
    want = {(r["id"], n) for r in rows for n, line in enumerate((r["body"] or "").split("\n"), 1) if norm(line) and (k := len(count[r["source_id"], norm(line)])) >= 4 and k >= 0.08 * total[r["source_id"]]}
    assert places(df, min_clusters=1, min_days=1) == want


def test_sameness_empty_lines_and_two_places(spark):
    bodies = [(1, f"Text {i} alone {chr(97 + i)}\n\n  Read More:\t{i * 7} \nREAD more: 5") for i in range(5)] + [(1, None), (1, ""), (2, "read more: 1")]
    assert places(frame(spark, bodies)) == {(i, n) for i in range(5) for n in (3, 4)}


def test_a_republished_article_is_no_boilerplate(spark):
    bodies = [(1, "Same story\nwith two lines")] * 6 + [(1, f"Own {chr(97 + i)}") for i in range(4)]
    assert places(frame(spark, bodies)) == set()
    assert len(places(frame(spark, bodies), min_clusters=1, min_days=1)) == 12


def test_clean_bodies(spark):
    bodies = [(None, f"Own {chr(97 + i)}\nNotice") for i in range(5)] + [(None, "Notice"), (None, None), (None, "x" * 300_000)]
    got = {r["id"]: (r["clean_body"], r["lines_removed"]) for r in B.without_boilerplate(frame(spark, bodies), "source_id", "id", "body", "fetched_at").collect()}
    assert got[0] == ("Own a", 1) and got[5] == ("", 1) and got[6] == (None, 0) and got[7][1] == 0


def test_report_tells_notices_from_republished_articles(spark):
    bodies = [(1, "Same story 1\nwith two lines")] * 6 + [(1, f"Own {chr(97 + i)}\n Notice {i}") for i in range(6)]
    got = {r["line_text"]: (r["rows"], r["clusters"], r["days"], r["source_rows"], r["boilerplate"]) for r in B.line_report(frame(spark, bodies), "source_id", "id", "body", "fetched_at").collect()}
    assert got == {"Same story 1": (6, 1, 1, 12, False), "with two lines": (6, 1, 1, 12, False), "Notice 0": (6, 6, 6, 12, True)}
    assert B.line_report(frame(spark, []), "source_id", "id", "body", "fetched_at").count() == 0


def test_republished_articles_with_a_new_dateline_stay(spark):
    """Copies that differ in case, digits and spaces collapse; only what different documents share is removed."""
    bodies = [(1, f"STORY of {i} May\nfirst  line\nsecond line\nShare  this") for i in range(8)] + [(1, f"Own {chr(97 + i)}\nshare this") for i in range(8)]
    got = [r["clean_body"] for r in B.without_boilerplate(frame(spark, bodies), "source_id", "id", "body", "fetched_at").orderBy("id").collect()]
    assert got == [f"STORY of {i} May\nfirst  line\nsecond line" for i in range(8)] + [f"Own {chr(97 + i)}" for i in range(8)]


def test_empty_table(spark):
    assert places(frame(spark, [])) == set()


def test_days_are_those_of_publication(spark, tmp_path):
    """One fetch day, five publication days: boilerplate; the reverse is none."""
    from terralens.llm import queries

    rows = [(i, 1, f"Own {chr(97 + i)}\nNotice", f"2024-01-0{i + 1}T10:00:00Z", datetime(2024, 2, 1)) for i in range(5)]
    rows += [(10 + i, 2, f"Own {chr(97 + i)}\nNotice", "2024-01-01T10:00:00Z", datetime(2024, 2, 1 + i)) for i in range(5)]
    spark.createDataFrame(rows, "id bigint, source_id int, body string, published_at string, fetched_at timestamp").write.parquet(f"{tmp_path}/news_items.parquet")
    spark.createDataFrame([(s, "x", "Europe/Kyiv", "dmy") for s in (1, 2)], "source_id int, name string, home_zone string, date_order string").write.parquet(f"{tmp_path}/source_clock.parquet")
    got = {r["id"]: r["lines_removed"] for r in queries.p6_clean_published(spark, str(tmp_path)).collect()}
    assert got == {i: 1 for i in range(5)} | {10 + i: 0 for i in range(5)}
