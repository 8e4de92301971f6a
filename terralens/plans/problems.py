"""Queries of the general data problems (timestamps, late events, points near points or regions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.io import table
from terralens.operators import late, spatial, stamps
from terralens.plans.stamps_sql import P2_SQL, P4_ALL_SQL, P4_SQL


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the three tables that aren't already in the one form, as UTC instants."""
    found = stamps.normalise_stamps(
        stamps.news_stamps(table(spark, sf_dir, "news_items"), table(spark, sf_dir, "source_clock"))
        .unionByName(stamps.geoconfirmed_stamps(table(spark, sf_dir, "geoconfirmed_head")))
        .unionByName(stamps.warspotting_stamps(table(spark, sf_dir, "warspotting_recent")))
    )
    return found.where(~F.col("raw").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).select("tbl", "row_key", stamps.as_utc(F.col("sec")).alias("utc")).distinct()


def p2_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table: stamps with so many readings, of them open ones, and how often the path took another than the cheapest."""
    found = stamps.normalise_stamps(
        stamps.news_stamps(table(spark, sf_dir, "news_items"), table(spark, sf_dir, "source_clock"))
        .unionByName(stamps.geoconfirmed_stamps(table(spark, sf_dir, "geoconfirmed_head")))
        .unionByName(stamps.warspotting_stamps(table(spark, sf_dir, "warspotting_recent")))
    )
    return found.groupBy("tbl", "readings", "open").agg(F.count(F.lit(1)).alias("stamps"), F.count_if("moved").alias("moved"))


def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, event_type, event_s, arrival_s`` of ``extracted_events``; exact duplicate rows count once."""
    news = table(spark, sf_dir, "news_items")
    events = table(spark, sf_dir, "extracted_events").select("id", "news_item_id", "event_type", F.unix_seconds(F.col("occurred_at").cast("timestamp")).alias("at")).distinct()
    published = stamps.normalise_stamps(stamps.news_stamps(news, table(spark, sf_dir, "source_clock"))).select(F.col("row_key").cast("bigint").alias("item"), F.col("sec").alias("published_s"))
    items = news.select(F.col("id").alias("item"), F.expr("unix_micros(cast(fetched_at as timestamp)) / 1000000.0D").alias("arrival_s"))
    return (
        events.join(items, events.news_item_id == items.item).drop("item")
        .join(published, F.col("at").isNull() & (F.col("news_item_id") == published.item), "left")
        .select("id", "event_type", F.coalesce("at", "published_s").alias("event_s"), "arrival_s")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrived late (more than 6 hours after their day's end) or beyond the cut-off (72 hours)."""
    placed = late.place(_event_records(spark, sf_dir), "event_s", "arrival_s")
    return late.with_outcome(placed, late.triangle(placed)).where("outcome <> 'on_time'").select("id", "event_day", "outcome").distinct()


def p4_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision of the daily event counts (event time: ``occurred_at`` alone), per event type; ``p4_all_revisions`` counts every event."""
    news = table(spark, sf_dir, "news_items").select(F.col("id").alias("item"), F.expr("unix_micros(cast(fetched_at as timestamp)) / 1000000.0D").alias("arrival_s"))
    events = table(spark, sf_dir, "extracted_events").select("id", "news_item_id", "event_type", F.unix_seconds(F.col("occurred_at").cast("timestamp")).alias("event_s")).distinct()
    placed = late.place(events.join(news, F.col("news_item_id") == F.col("item")), "event_s", "arrival_s")
    return late.triangle(placed, ("event_type",)).select("event_type", "event_day", "lag_h", "outcome", "arrived", "revision", "total", "beyond")


def p4_all_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision of the daily event counts (event time: ``occurred_at``, else the item's ``published_at``), per event type."""
    placed = late.place(_event_records(spark, sf_dir), "event_s", "arrival_s")
    return late.triangle(placed, ("event_type",)).select("event_type", "event_day", "lag_h", "outcome", "arrived", "revision", "total", "beyond")


P4_REVISIONS_SQL = """
WITH e AS (SELECT DISTINCT id, news_item_id, event_type, CAST(floor(epoch(occurred_at)) AS BIGINT) AS event_s FROM extracted_events),
r AS (SELECT event_type, event_s // 86400 AS day, epoch_us(n.fetched_at) / 1e6 AS arrival_s
      FROM e JOIN news_items n ON n.id = e.news_item_id WHERE event_s IS NOT NULL AND n.fetched_at IS NOT NULL),
p AS (SELECT event_type, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS event_day,
             CAST(greatest(0, ceil((arrival_s - (day + 1) * 86400) / 3600)) AS BIGINT) AS lag_h FROM r),
c AS (SELECT event_type, event_day, lag_h, CASE WHEN lag_h <= 6 THEN 'on_time' WHEN lag_h <= 72 THEN 'late' ELSE 'cut' END AS outcome, count(*) AS arrived
      FROM p GROUP BY ALL)
SELECT event_type, event_day, lag_h, outcome, arrived, row_number() OVER w AS revision,
       CAST(sum(CASE WHEN outcome <> 'cut' THEN arrived ELSE 0 END) OVER w AS BIGINT) AS total,
       CAST(sum(CASE WHEN outcome = 'cut' THEN arrived ELSE 0 END) OVER w AS BIGINT) AS beyond
FROM c WINDOW w AS (PARTITION BY event_type, event_day ORDER BY lag_h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spatial.with_point(table(spark, sf_dir, name).select("id", "geom"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and reports in active zones, events within 5 km of a claim, reports within 3 km of each other."""
    events, reports, claims = (_points(spark, sf_dir, t) for t in ("extracted_events", "synthesized_reports", "frontline_claims"))
    zones = table(spark, sf_dir, "blackout_zones").where("active").select(F.col("id").cast("bigint").alias("zone"), "geom")

    def kind(name: str, df: DataFrame, left: str, right: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col(left).alias("left_id"), F.col(right).alias("right_id"))

    return (
        kind("event_zone", spatial.points_in_regions(events, zones, "id", "zone"), "id", "zone")
        .union(kind("report_zone", spatial.points_in_regions(reports, zones, "id", "zone"), "id", "zone"))
        .union(kind("claim_event", spatial.distance_join(claims.withColumnRenamed("id", "claim"), events, "claim", "id", 5000.0), "claim", "id"))
        .union(kind("report_report", spatial.distance_join(reports.withColumnRenamed("id", "a"), reports.withColumnRenamed("id", "b"), "a", "b", 3000.0, ordered=True), "a", "b"))
        .distinct()
    )


_D = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b}.y - {a}.y) / 2), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * pow(sin(radians({b}.x - {a}.x) / 2), 2))))"
P7_SQL = f"""
WITH pts AS (
  SELECT DISTINCT t, id, CAST(regexp_extract(geom, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 1) AS DOUBLE) AS x, CAST(regexp_extract(geom, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 2) AS DOUBLE) AS y
  FROM (SELECT 'e' AS t, id, geom FROM extracted_events UNION ALL SELECT 'r', id, geom FROM synthesized_reports UNION ALL SELECT 'c', id, geom FROM frontline_claims) WHERE geom IS NOT NULL),
rings AS (SELECT id AS zone, unnest(regexp_extract_all(geom, '\\(([^()]+)\\)', 1)) AS ring FROM blackout_zones WHERE active),
pos AS (SELECT zone, row_number() OVER () AS n, string_split(ring, ',') AS p FROM rings),
ends AS (SELECT zone, n, i, trim(p[i]) AS a, trim(p[i + 1]) AS b FROM pos, range(1, 2000) r(i) WHERE i < len(p)),
edges AS (SELECT zone, CAST(split_part(a, ' ', 1) AS DOUBLE) AS x1, CAST(split_part(a, ' ', 2) AS DOUBLE) AS y1, CAST(split_part(b, ' ', 1) AS DOUBLE) AS x2, CAST(split_part(b, ' ', 2) AS DOUBLE) AS y2 FROM ends),
hits AS (SELECT t, id, zone, CASE WHEN ((y1 > y) <> (y2 > y)) AND (CASE WHEN y2 > y1 THEN (x2-x1)*(y-y1) - (x-x1)*(y2-y1) > 0 ELSE (x2-x1)*(y-y1) - (x-x1)*(y2-y1) < 0 END) THEN 1 ELSE 0 END AS c,
    abs((x2-x1)*(y-y1) - (x-x1)*(y2-y1)) < 5e-13 AND x BETWEEN least(x1,x2) AND greatest(x1,x2) AND y BETWEEN least(y1,y2) AND greatest(y1,y2) AS on_edge
  FROM pts JOIN edges ON y BETWEEN least(y1,y2) AND greatest(y1,y2) WHERE t IN ('e','r'))
SELECT CASE t WHEN 'e' THEN 'event_zone' ELSE 'report_zone' END AS kind, id AS left_id, CAST(zone AS BIGINT) AS right_id FROM hits GROUP BY t, id, zone HAVING sum(c) % 2 = 1 OR bool_or(on_edge)
UNION SELECT 'claim_event', a.id, b.id FROM pts a JOIN pts b ON a.t = 'c' AND b.t = 'e' AND b.y BETWEEN a.y - 0.06 AND a.y + 0.06 AND {_D.format(a="a", b="b")} <= 5000
UNION SELECT 'report_report', a.id, b.id FROM pts a JOIN pts b ON a.t = 'r' AND b.t = 'r' AND a.id < b.id AND b.y BETWEEN a.y - 0.04 AND a.y + 0.04 AND {_D.format(a="a", b="b")} <= 3000
"""

QUERIES = {"p2_found": p2_found, "p2_readings": p2_readings, "p4_found": p4_found, "p4_revisions": p4_revisions, "p4_all_revisions": p4_all_revisions, "p7_found": p7_found}
ORACLES = {"p2_found": P2_SQL, "p4_found": P4_SQL, "p4_revisions": P4_REVISIONS_SQL, "p4_all_revisions": P4_ALL_SQL, "p7_found": P7_SQL}
