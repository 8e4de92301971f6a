"""Streams against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terralens.streaming import streams as St


def _table(spark, path, n=200):
    rows = [(i % 50, f"t{i % 3}", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(n)]
    spark.createDataFrame(rows, "id bigint, kind string, at timestamp").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_daily_counts_equal_batch(spark, tmp_path):
    batch = _table(spark, str(tmp_path / "t"))
    stream = St.table_stream(spark, str(tmp_path / "t"), 1000)
    counts = St.run_once(St.daily_counts(stream, "at", ("kind",), "30 days"), "complete", str(tmp_path / "c"))
    got = {(r["day"], r["kind"], r["n"]) for r in counts.collect()}
    assert got == {(r["day"], r["kind"], r["n"]) for r in batch.groupBy(F.date_trunc("day", "at").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_first_seen_and_sessions(spark, tmp_path):
    _table(spark, str(tmp_path / "t"))
    stream = St.table_stream(spark, str(tmp_path / "t"), 1000)
    assert St.run_once(St.first_seen(stream, "id", "at", "30 days"), "append", str(tmp_path / "c1")).count() == 50
    bursts = St.run_once(St.sessions(stream, "at", ("kind",), "5 hours", "1 hour"), "complete", str(tmp_path / "c2"))
    assert {(r["kind"], r["n"]) for r in bursts.collect()} == {("t0", 67), ("t1", 67), ("t2", 66)}


def test_a_stream_without_input(spark, tmp_path):
    spark.createDataFrame([], "id bigint, kind string, at timestamp").write.parquet(str(tmp_path / "t"))
    assert St.run_once(St.daily_counts(St.table_stream(spark, str(tmp_path / "t")), "at", ("kind",)), "complete", str(tmp_path / "c")).count() == 0


def test_health(spark, tmp_path):
    polls = [(1, False, 0)] * 6 + [(2, True, 0)] * 5 + [(3, False, 0)] * 25 + [(4, True, 3)]
    spark.createDataFrame(polls, "source_id int, ok boolean, items int").coalesce(1).write.parquet(str(tmp_path / "p"))
    health = St.run_once(St.source_health(St.table_stream(spark, str(tmp_path / "p"))), "update", str(tmp_path / "c"))
    assert {(r["source_id"], r["status"]) for r in health.collect()} == {(1, "degraded"), (2, "degraded"), (3, "dead"), (4, "ok")}


def test_batches_are_handed_on(spark, tmp_path):
    _table(spark, str(tmp_path / "t"))
    St.each_batch(St.table_stream(spark, str(tmp_path / "t"), 1), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={n}")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
