"""Readers and sinks on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terralens.sources import files, sinks


def test_semicolon_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Date;Name;Latitude;Longitude;Id\n;"A, b";48.1;37.2;x1\n16-04-2024;"two\nlines";48.2;37.3;x2\n2024/04/09;n;;;x3\n31-02-2024;n;1;2;x4\n', encoding="utf-8")
    rows = {r["Id"]: r for r in files.geolocated_csv(spark, str(p)).collect()}
    assert set(rows) == {"x1", "x2", "x4"} and rows["x1"]["published_at"] is None and rows["x2"]["published_at"].day == 16 and rows["x4"]["published_at"] is None and rows["x1"]["Name"] == "A, b"
    kept = files.recent(files.geolocated_csv(spark, str(p)), "published_at", F.lit("2025-01-01").cast("timestamp"))
    assert {r["Id"] for r in kept.collect()} == {"x1", "x4"}
    p.write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        files.geolocated_csv(spark, str(p))


def test_losses(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps({"losses": [{"id": 1, "model": "m", "status": "destroyed", "geo": "48.1, 37.2", "tags": "a, b", "date": "2024-01-05x", "nearest_location": "N"}, {"id": 2, "geo": "", "tags": None}, {"id": 3, "type": "T", "geo": " 1,2 ", "tags": ["c"]}, {"id": 4, "geo": "x,y"}]}))
    rows = {r["id"]: r for r in files.losses_json(spark, str(p)).collect()}
    assert set(rows) == {1, 3} and rows[1]["tag_list"] == ["a", "b"] and rows[3]["tag_list"] == ["c"] and rows[1]["title"] == "m destroyed near N" and rows[3]["title"] == "T lost" and (rows[3]["lat"], rows[3]["lon"]) == (1, 2)


def test_layers(spark, tmp_path):
    ring = [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 0, 0]]

    def feature(token, kind="Polygon"):
        return {"properties": {"name": f"x /// geoJSON.{token}" if token else "plain"}, "geometry": {"type": kind, "coordinates": [ring] if kind == "Polygon" else [[ring]] if kind == "MultiPolygon" else [0, 0]}}

    p = tmp_path / "g.json"
    p.write_text(json.dumps({"id": 5, "map": {"features": [feature("status.occupied"), feature("territories.crimea", "MultiPolygon"), feature("status.unknown"), feature("status.dismissed"), feature(""), feature("status.occupied", "Point")]}}))
    rows = files.control_layers(spark, str(p)).collect()
    assert sorted((r["layer"], r["token"]) for r in rows) == [("dropped", "status.dismissed"), ("dropped", "untokenised"), ("grey", "status.unknown"), ("occupied", "status.occupied"), ("occupied", "territories.crimea")]
    assert all(r["geom"] == "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)))" for r in rows)
    ids = spark.createDataFrame([("1700000000",), ("12",), ("x",), (None,)], "i string").select(files.snapshot_instant(F.col("i")).alias("s"))
    assert [r["s"] for r in ids.collect()] == [1700000000, None, None, None]


def test_feeds_and_pages(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rss><channel><item><guid>g1</guid><title>T &amp;amp; t</title><link>http://l/1</link><description>&lt;p&gt;One&lt;br&gt;two&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;</description><pubDate>Mon, 09 Sep 2024 17:47:20 +0300</pubDate></item></channel></rss>')
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://l/2"/><content>B</content><updated>2024-01-01T00:00:00Z</updated></entry></feed>')
    (tmp_path / "c.xml").write_text("no feed")
    rows = {r["external_id"]: r for r in files.feeds(spark, str(tmp_path / "*.xml")).collect()}
    assert rows["g1"]["title"] == "T & t" and rows["g1"]["body"].split() == ["One", "two"] and rows["http://l/2"]["body"] == "B" and len(rows) == 2
    assert files.feed_instant(rows["g1"]["published"]) == 1725893240
    (tmp_path / "p.html").write_text('<div class="message" data-post="c/7"><div class="message_text">--<br>Short<br/>A longer second line here</div><time datetime="2024-01-01T00:00:00+00:00"></time></div><div class="message" data-post="c/8"><img src="x"></div><div class="message" data-post="c/9"><div class="message_text"><b>Bold</b> rest</div></div>')
    posts = files.channel_pages(spark, str(tmp_path / "p.html"))
    got = {r["external_id"]: (r["title"], r["published"]) for r in posts.collect()}
    assert got == {"c/7": ("Short A longer second line here", "2024-01-01T00:00:00+00:00"), "c/9": ("Bold rest", None)}
    assert [r["external_id"] for r in files.newer_posts(posts, 7).collect()] == ["c/9"]


def test_places(spark, tmp_path):
    line = ["1", "Name", "Name", "", "48.1", "37.2", "P", "PPL", "UA", "", "05", "", "", "", "120", "", "", "tz", "d"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("UA.txt", "\n".join(["\t".join(line), "\t".join([*line[:7], "ADM1", *line[8:]]), "broken"]))
        z.writestr("readme.txt", "x")
    assert [(r["name"], r["lat"], r["population"]) for r in files.places_zip(spark, str(tmp_path / "p.zip")).collect()] == [("Name", 48.1, 120)]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": " N ", "population": "1 200"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"name:uk": "U", "population": "x"}}, {"tags": {"name": "nowhere"}}, {"lat": 1.0, "lon": 1.0, "tags": {}}]}))
    assert sorted((r["name_uk"], r["lat"], r["population"]) for r in files.places_json(spark, str(tmp_path / "o.json")).collect()) == [("N", 1.0, 1200), ("U", 3.0, None)]
    (tmp_path / "k.csv").write_text("a;b\n1,2;3\n1;2,5\n")
    assert files.sniffed_csv(spark, str(tmp_path / "k.csv")).columns == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "c", 5)], "k int, v string, t int")
    assert sorted(r["v"] for r in sinks.new_rows(df, spark.createDataFrame([(2,)], "k int"), ["k"], ["t"]).collect()) == ["b"]
    root = str(tmp_path / "table")
    assert sinks.current_version(spark, root) is None
    assert (sinks.write_version(df, root), sinks.write_version(df.limit(1), root)) == (1, 2)
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root + "-none")
    for _ in range(2):
        sinks.append_audit(spark, f"{root}-audit", "me", "merge", "report:1", {"b": 1, "a": None})
    assert [r["detail"] for r in spark.read.parquet(f"{root}-audit").collect()] == ['{"a": null, "b": 1}'] * 2
    assert sinks.read_version(spark, root).count() == 1 and sinks.read_version(spark, root, 1).count() == 3
    parts = str(tmp_path / "parts")
    sinks.replace_partitions(df, parts, ["k"])
    sinks.replace_partitions(df.where("k = 1").limit(1), parts, ["k"])
    assert spark.read.parquet(parts).count() == 2
    assert sinks.weak_etag(df) == sinks.weak_etag(df.orderBy(F.desc("t"))) != sinks.weak_etag(df.limit(2))
    assert sinks.params_key(a=1, b=None) == sinks.params_key(a=1) != sinks.params_key(a=2)


def test_items_and_sizes_of_exports(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date;Name;Latitude;Longitude;Id;Geolocation;Source;Description\n16-04-2024;" + "n" * 300 + ";48.1;37.2;x1;;https://s;d\n;;48.1;37.2;x2;https://g;;\n")
    rows = {r["external_id"]: r for r in files.geolocated_items(files.geolocated_csv(spark, str(p))).collect()}
    assert len(rows["x1"]["title"]) == 200 and rows["x1"]["url"] == "https://s" and rows["x1"]["body"] == "d" and rows["x2"]["title"] == "x2" and rows["x2"]["url"] == "https://g"
    assert files.complete_export(spark, str(p), 100) == str(p)
    with pytest.raises(ValueError):
        files.complete_export(spark, str(p))


def test_days_history_and_edits(spark, tmp_path):
    for day, i in (("2024-01-05", 1), ("2024-01-03", 2), ("2023-12-01", 3)):
        (tmp_path / f"{day}.json").write_text(json.dumps({"losses": [{"id": i, "geo": "1,2"}]}))
    assert {r["id"] for r in files.losses_by_date(spark, f"{tmp_path}/{{day}}.json", "2024-01-06").collect()} == {1, 2}
    assert files.losses_by_date(spark, f"{tmp_path}/{{day}}.json", "2030-01-06").count() == 0
    (tmp_path / "h.json").write_text(json.dumps([{"id": "1700000900"}, {"id": "1700000000"}, {"id": "b", "createdAt": "2024-01-01T00:00:00Z"}, {"id": "c"}, {"createdAt": 1700000000000}, {"id": "d", "createdAt": 1700000500000}]))
    assert [(r["id"], r["valid_s"]) for r in files.history_index(spark, str(tmp_path / "h.json")).collect()] == [("1700000000", 1700000000), ("d", 1700000500), ("1700000900", 1700000900), ("b", 1704067200)]
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    (tmp_path / "e.json").write_text(json.dumps({"features": [{"properties": {"EditDate": 5}, "geometry": square}, {"properties": {"EditDate": 9}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    layer, newest = files.edited_layer(spark, str(tmp_path / "e.json"))
    assert newest == 9 and layer.count() == 1 and files.edited_layer(spark, str(tmp_path / "e.json"), 9)[0].count() == 0
    assert files.service_name(["Old_Layer", "Assessed_2024"], ["assessed", "layer"]) == "Assessed_2024" and files.service_name(["x"], ["y"]) is None


def test_watermarks_pagers_and_columns(spark, tmp_path):
    posts = spark.createDataFrame([("c/7",), ("c/9",), (None,)], "external_id string")
    new, top, empty = files.watermark(posts, 7)
    assert [r[0] for r in new.collect()] == ["c/9"] and top == 9 and not empty
    assert files.watermark(posts.limit(0), 7)[1:] == (7, True) and files.watermark(posts.where("external_id = 'c/7'"), 8)[1:] == (8, False)
    history = {n: {"number": n, "at_s": n * 10} for n in range(1, 40)}
    read = lambda before: [history[n] for n in range(max(1, before - 5), before)]
    assert [p[0]["number"] for p in files.backward_pages(read, 40, 200)] == [35, 30, 25, 20, 15] and len(files.backward_pages(read, 40, 0, 3)) == 3
    assert files.backward_pages(lambda _: [], 40, 0) == [] and len(files.backward_pages(read, 4, 0)) == 1
    df = spark.createDataFrame([("x", "UA12"), ("y", "UA34"), ("", "z"), (None, "UA5")], "`a b` string, code string")
    assert files.column_of(df, "^UA\\d+") == "code" and files.column_of(df, "^q") is None and files.column_of(df.limit(0), "x") is None


def test_catalogue(spark):
    names = "title affiliation_perspective access primary_platform handle_or_feed url machine_readable update_frequency reliability_notes source_type category language".split()
    rows = [
        ("A", "Ukr", "Free", "Telegram", "@chan", None, "", "daily", None, None, "news", "uk"), ("B", "Ukr", "free tier", "Web", "https://b.example/x https://b.example/feed.xml", "https://b.example", "RSS", "hourly", None, None, None, None),
        ("C", "Ukr", "paid", "Web", "https://c.example/rss", None, "RSS", "", None, None, None, None), ("D", "?", "free", "Web", "https://d.example/rss", None, "RSS", "", None, None, None, None), ("AA", "Ukr", "free", "Telegram", None, "https://t.me/s/chan", "", "", None, None, None, None),
        ("E", "Rus", "free", "Web", None, "https://e.example", "no", "", None, None, None, None), (None, "Ukr", "free", "Telegram", "@x", None, "", "", None, None, None, None),
    ]
    got = {r["name"]: r for r in files.source_catalogue(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), {"Ukr": "ukrainian", "Rus": "russian"}, {"daily": 86400}, ("b",)).collect()}
    assert set(got) == {"A", "B"} and got["A"]["url"] == "https://t.me/s/chan" and got["A"]["meta"] == {"slug": "chan", "category": "news", "language": "uk"} and got["A"]["poll_interval_s"] == 86400 and not got["A"]["enabled"]
    assert got["B"]["url"] == "https://b.example/feed.xml" and got["B"]["type"] == "feed" and got["B"]["enabled"] and got["B"]["poll_interval_s"] == 900


def test_city_districts_and_tallies(spark, tmp_path):
    line = ["1", "D", "D", "", "48.1", "37.2", "A", "ADM2", "UA", "", "12", "", "", "", "0", "", "", "tz", "d"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("UA.txt", "\n".join(["\t".join(line), "\t".join([*line[:10], "05", *line[11:]])]))
    assert files.places_zip(spark, str(tmp_path / "p.zip")).count() == 0 and files.places_zip(spark, str(tmp_path / "p.zip"), city_regions=("12",)).count() == 1
    layers = spark.createDataFrame([("dropped", "a"), ("dropped", "a"), ("grey", "b")], "layer string, token string")
    assert {tuple(r) for r in files.dropped_tokens(layers).collect()} == {("a", 2)}
