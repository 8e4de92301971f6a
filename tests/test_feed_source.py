"""The feed source in batch and stream; query parameters."""

import os

import pytest

from terralens.functions import params as P
from terralens.sources.feed_source import FeedSource


def _feed(path, *ids):
    path.write_text("<rss><channel>" + "".join(f"<item><guid>{i}</guid><title>t</title><pubDate>Mon, 09 Sep 2024 17:47:20 +0300</pubDate></item>" for i in ids) + "</channel></rss>")


def test_batch_and_conditional_polls(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    folder = tmp_path / "feeds"
    folder.mkdir()
    _feed(folder / "a.xml", 1, 2)
    _feed(folder / "b.xml", 3)
    rows = spark.read.format("terralens_feed").load(str(folder)).collect()
    assert sorted(r["external_id"] for r in rows) == ["1", "2", "3"] and {r["published_s"] for r in rows} == {1725893240}
    q = spark.readStream.format("terralens_feed").load(str(folder)).writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("polled").count() == 3
        q.processAllAvailable()
        assert spark.table("polled").count() == 3
        _feed(folder / "b.xml", 3, 4)
        os.utime(folder / "b.xml", ns=(1, 1))
        q.processAllAvailable()
        assert sorted(r["external_id"] for r in spark.table("polled").collect()) == ["1", "2", "3", "3", "4"]
    finally:
        q.stop()


def test_params():
    assert P.instant("2024-01-01T00:00:00Z") == P.instant("2024-01-01T02:00:00 02:00") == P.instant("2024-01-01T00:00:00") == 1704067200 and P.instant("") is None
    with pytest.raises(ValueError):
        P.instant("yesterday")
    assert P.choice("a, b", {"a", "b", "c"}) == ["a", "b"] and P.choice("", {"a"}) is None
    with pytest.raises(ValueError):
        P.choice("a,x", {"a"})
    assert P.window_start(1_000_119, 1, 120) == P.window_start(1_000_100, 1, 120)
    assert P.cursor("7@2024-01-01T00:00:00Z") == (1704067200, 7) and P.cursor("0@x") is None and P.cursor(None) is None
    assert P.split_slots({"a": 100, "b": 1, "c": 0}, 12) == {"a": 11, "b": 1, "c": 0} and sum(P.split_slots({"a": 2, "b": 1}, 12).values()) == 3
