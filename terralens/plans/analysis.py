"""Queries of the operators that need more than one expression: overlays, similarity, streams, name keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions import text
from terralens.io import scratch, table
from terralens.operators import overlay, similarity
from terralens.operators import relational as rel
from terralens.plans.analysis_sql import OVERLAY_AREA, SIMILAR_PLACE, SIMILARITY
from terralens.plans.serving import EV, events, news
from terralens.streaming import streams

DAY = 86400


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blackout_zones").select(F.when(F.col("active"), "active").otherwise("inactive").alias("layer"), "geom")


def overlay_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square kilometres covered by active zones only, inactive only, and both."""
    t = overlay.with_area(overlay.overlay(_zones(spark, sf_dir), "layer"))
    return t.groupBy(F.array_join("layers", "+").alias("layers")).agg(F.round(F.sum("area_m2") / 1e6, 3).alias("km2"))


def overlay_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected pieces of the zones' union of at least half a square kilometre."""
    t = overlay.without_slivers(overlay.overlay(_zones(spark, sf_dir), "layer"), 5e5)
    return t.groupBy("part").agg(F.round(F.sum("area_m2") / 1e6, 3).alias("km2"), F.round(F.min("x0"), 6).alias("west"), F.round(F.max("x1"), 6).alias("east")).drop("part")


def zone_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with coarser outlines."""
    return table(spark, sf_dir, "blackout_zones").select("id", overlay.simplify_wkt(F.col("geom"), 0.05).alias("geom"))


def word_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most similar gazetteer entries for each distinct place name."""
    names = table(spark, sf_dir, "extracted_events").where("place_name_raw IS NOT NULL").select("place_name_raw").distinct().select(similarity.name_key(F.col("place_name_raw")).alias("q")).distinct()
    g = table(spark, sf_dir, "gazetteer").select("id", "population", F.array_join(F.array_distinct(F.array(*[similarity.name_key(F.col(c)) for c in ("name_uk", "name_ru", "name_en")])), " ").alias("blob"))
    return similarity.similar(names.where("length(q) >= 3"), "q", g, "id", "blob", "population")


def similar_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each name's nearly best entries the most populous."""
    top = word_similarity_topk(spark, sf_dir).join(table(spark, sf_dir, "gazetteer").select(F.col("id").alias("entry"), "population"), "entry")
    return similarity.best_of_ties(top, "query", "score", "population", "entry").select("query", "entry", "score")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by UTC day and type, counted by a stream over the table's files."""
    stream = streams.table_stream(spark, f"{sf_dir}/extracted_events.parquet")
    counts = streams.run_once(streams.daily_counts(stream, "occurred_at", ("event_type",), "3650 days"), "complete", f"{scratch(spark)}/daily_{uuid.uuid4().hex[:12]}")
    return counts.select(F.floor(F.unix_seconds("day") / DAY).alias("day"), "event_type", "n")


Q_STREAM = f"SELECT CAST(floor(epoch(occurred_at)) AS BIGINT) // {DAY} AS day, event_type, count(*) AS n FROM extracted_events WHERE occurred_at IS NOT NULL GROUP BY ALL"


def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of arrivals of each source: half an hour without an item closes one."""
    s = rel.sessions(news(spark, sf_dir), ["source_id"], "fetched_s", 1800)
    return s.groupBy("source_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("fetched_s").alias("first_s"))


Q_BURSTS = "WITH n AS (SELECT source_id, CAST(floor(epoch(fetched_at)) AS BIGINT) AS f FROM news_items), g AS (SELECT source_id, f, CASE WHEN f - lag(f) OVER (PARTITION BY source_id ORDER BY f) > 1800 THEN 1 ELSE 0 END AS brk FROM n), s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY source_id ORDER BY f) + 1 AS BIGINT) AS session FROM g) SELECT source_id, session, count(*) AS n, min(f) AS first_s FROM s GROUP BY ALL"


def nested_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the oblast and country that their nested record names."""
    return events(spark, sf_dir, "llm_raw").groupBy(F.col("llm_raw.oblast").alias("oblast"), F.col("llm_raw.country").alias("country")).agg(F.count(F.lit(1)).alias("n"))


Q_HINTS = f"WITH {EV} SELECT llm_raw.oblast AS oblast, llm_raw.country AS country, count(*) AS n FROM ev GROUP BY ALL"


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies wrapped as HTML and stripped of it again."""
    html = F.concat(F.lit("<p class='x'>"), F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("<br/>")), F.lit("</p><script>no()</script>"))
    return news(spark, sf_dir).where("body IS NOT NULL").select("id", text.strip_html(html).alias("body"))


Q_PLAIN = r"""WITH h AS (SELECT id, '<p class=''x''>' || replace(replace(body, '&', '&amp;'), chr(10), '<br/>') || '</p><script>no()</script>' AS c FROM news_items WHERE body IS NOT NULL),
a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(c, '(?is)<script.*?</script>', ' ', 'g'), '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g') AS c FROM h)
SELECT id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '[ \t]*\n\s*\n+', chr(10) || chr(10), 'g'), '^[\s\p{Z}\x0b\x{0085}]+|[\s\p{Z}\x0b\x{0085}]+$', '', 'g') AS body FROM a"""

_ALL = ((overlay_area, OVERLAY_AREA), (overlay_parts, None), (zone_outlines, None), (word_similarity_topk, SIMILARITY), (similar_place, SIMILAR_PLACE), (stream_daily_counts, Q_STREAM), (batch_sessions, Q_BURSTS), (nested_hints, Q_HINTS), (plain_text, Q_PLAIN))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: q for f, q in _ALL if q}
