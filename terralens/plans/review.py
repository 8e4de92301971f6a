"""Queries for a reviewer's pages: spans of the timeline, gaps, states, loose values, places to settle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralens.functions import values
from terralens.io import table
from terralens.operators import relational as rel
from terralens.operators import similarity
from terralens.plans.serving import DAY, EV, NEWS, NOW_S, STAR, events, news, sec, star

KINDS = ("shelling", "deep_strike", "debunk", "geolocation_proof", "frontline_advance", "frontline_claim")


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 fullest grid cells (the limit is the feature)."""
    cells = rel.grid_clusters(star(spark, sf_dir, "event_type lon lat", "visible AND lon IS NOT NULL"), 8, {"n_debunk": F.col("event_type") == "debunk"}, 40)
    return cells.select("cx", "cy", "n", "n_debunk")


Q_TOP = f"WITH {STAR} SELECT CAST(round_even(lon / 0.08, 0) AS BIGINT) AS cx, CAST(round_even(lat / 0.08, 0) AS BIGINT) AS cy, count(*) AS n, count(*) FILTER (event_type = 'debunk') AS n_debunk FROM star WHERE lon IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, cx, cy LIMIT 40"


def timeline_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable span of the timeline in one row: from the earlier of the first claim and the first percentile of events to the later of both ends, with the claims' instants."""
    e = events(spark, sf_dir, "occurred_s", "lon IS NOT NULL AND occurred_at IS NOT NULL")
    first = rel.percentile_disc(e.withColumn("one", F.lit(1)), ["one"], "occurred_s", 0.01).select("occurred_s").scalar()
    at = sec("created_at")
    days = F.array_join(F.array_sort(F.collect_set(F.floor(at / DAY))).cast("array<string>"), ",")
    claims = table(spark, sf_dir, "frontline_claims").agg(F.min(at).alias("front_from"), F.max(at).alias("front_to"), F.count(F.lit(1)).alias("snapshots"), days.alias("days"))
    span = F.least(first, F.col("front_from")).alias("from_s"), F.greatest(e.agg(F.max("occurred_s")).scalar(), F.col("front_to")).alias("to_s")
    return claims.select(*span, e.agg(F.min("occurred_s")).scalar().alias("events_from"), "front_from", "front_to", "snapshots", "days")


Q_SPAN = f"""WITH {EV}, e AS (SELECT CAST(percentile_disc(0.01) WITHIN GROUP (ORDER BY occurred_s) AS BIGINT) AS ev_from, min(occurred_s) AS events_from, max(occurred_s) AS ev_to FROM ev WHERE lon IS NOT NULL AND occurred_s IS NOT NULL),
a AS (SELECT CAST(floor(epoch(created_at)) AS BIGINT) AS made_s FROM frontline_claims), c AS (SELECT min(made_s) AS front_from, max(made_s) AS front_to, count(*) AS snapshots FROM a), d AS (SELECT string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM (SELECT DISTINCT made_s // {DAY} AS day FROM a WHERE made_s IS NOT NULL))
SELECT least(ev_from, front_from) AS from_s, greatest(ev_to, front_to) AS to_s, events_from, front_from, front_to, snapshots, days FROM e, c, d"""


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the first and the last claim of a direction on which none was made: what a backfill has to build."""
    c = table(spark, sf_dir, "frontline_claims").where("created_at IS NOT NULL").select("direction", F.floor(sec("created_at") / DAY).alias("day"))
    span = c.groupBy("direction").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return span.select("direction", F.explode(F.sequence("a", "b")).alias("day")).join(c.distinct(), ["direction", "day"], "left_anti")


Q_MISSING = f"WITH c AS (SELECT DISTINCT direction, CAST(floor(epoch(created_at)) AS BIGINT) // {DAY} AS day FROM frontline_claims WHERE created_at IS NOT NULL), s AS (SELECT direction, unnest(generate_series(min(day), max(day))) AS day FROM c GROUP BY 1) SELECT direction, day FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.direction = s.direction AND c.day = s.day)"


def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending claims that are older than two weeks, as is the last change to them."""
    c = table(spark, sf_dir, "frontline_claims").where("status = 'pending'").select("id", sec("created_at").alias("created_s"), sec("updated_at").alias("updated_s"))
    return c.where((F.col("created_s") < NOW_S - 14 * DAY) & (F.coalesce("updated_s", "created_s") < NOW_S - 14 * DAY)).select("id", "created_s")


Q_STALE = f"SELECT id, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s FROM frontline_claims WHERE status = 'pending' AND floor(epoch(created_at)) < {NOW_S - 14 * DAY} AND floor(epoch(coalesce(updated_at, created_at))) < {NOW_S - 14 * DAY}"


def failing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's items that failed since its last one that didn't, and the state that makes."""
    n = news(spark, sf_dir).where("fetched_at IS NOT NULL").select("source_id", "fetched_s", (F.col("llm_status") == "failed").alias("failed"))
    good = n.where("NOT failed").groupBy(F.col("source_id").alias("s")).agg(F.max("fetched_s").alias("good_s"))
    late = n.join(good, F.col("source_id").eqNullSafe(F.col("s")), "left").groupBy("source_id").agg(F.count_if(F.col("failed") & (F.col("good_s").isNull() | (F.col("fetched_s") > F.col("good_s")))).alias("failures"))
    return late.withColumn("status", values.failure_status(F.col("failures")))


Q_FAILING = f"WITH {NEWS}, g AS (SELECT source_id, max(fetched_s) AS good_s FROM nw WHERE llm_status <> 'failed' AND fetched_at IS NOT NULL GROUP BY 1), f AS (SELECT source_id, count(*) FILTER (llm_status = 'failed' AND (good_s IS NULL OR fetched_s > good_s)) AS failures FROM nw LEFT JOIN g USING (source_id) WHERE fetched_at IS NOT NULL GROUP BY 1) SELECT source_id, failures, CASE WHEN failures >= 20 THEN 'dead' WHEN failures >= 5 THEN 'degraded' ELSE 'ok' END AS status FROM f"


def coerced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their loose values made usable."""
    e = table(spark, sf_dir, "extracted_events").select("id", "event_type", "lat", "lon", "confidence", "llm_raw.country").distinct()
    point = values.both_or_none(F.col("lat").cast("string"), F.col("lon").cast("string"))
    return e.select("id", values.kind_or(F.col("event_type"), KINDS).alias("kind"), point["lat"].alias("lat"), point["lon"].alias("lon"), values.fraction(F.col("confidence").cast("string")).alias("confidence"), values.country_code(F.col("country")).alias("country"))


Q_COERCED = f"SELECT DISTINCT id, CASE WHEN event_type IN {KINDS} THEN event_type ELSE 'other' END AS kind, CASE WHEN lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon, CASE WHEN confidence IS NOT NULL THEN least(1.0, greatest(0.0, confidence)) END AS confidence, CASE WHEN lower(trim(llm_raw.country)) IN ('ua','ru','by','md','other') THEN lower(trim(llm_raw.country)) ELSE MAP {{'ukraine': 'ua', 'russia': 'ru', 'belarus': 'by', 'moldova': 'md'}}[lower(trim(llm_raw.country))] END AS country FROM extracted_events"


def item_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each item came, as a reader is told."""
    return news(spark, sf_dir).where(f"fetched_s <= {NOW_S}").select("id", values.relative_time(F.col("fetched_s"), F.lit(NOW_S)).alias("age"))


Q_AGES = f"WITH {NEWS}, m AS (SELECT id, CAST(floor(({NOW_S} - fetched_s) / 60 + 0.5) AS BIGINT) AS mins FROM nw WHERE fetched_s <= {NOW_S}), h AS (SELECT *, CAST(floor(mins / 60 + 0.5) AS BIGINT) AS hours FROM m) SELECT id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN mins || ' min ago' WHEN hours < 24 THEN hours || ' h ago' ELSE CAST(floor(hours / 24 + 0.5) AS BIGINT) || ' d ago' END AS age FROM h"


def _gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The gazetteer with its names' keys, and the spellings of its regions (a short list of its own): the key, and the key as an adjective."""
    g = table(spark, sf_dir, "gazetteer").select("id", "population", "oblast", F.array_join(F.array_distinct(F.array(*[similarity.name_key(F.col(c)) for c in ("name_uk", "name_ru", "name_en")])), " ").alias("blob"))
    keys = [r[0] for r in g.where("oblast IS NOT NULL").select("oblast").distinct().collect()]
    return g, {k: [k, f"{k}ska"] for k in keys}


def hinted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place each name means, by the region that its hint names, or else in the whole list."""
    g, regions = _gazetteer(spark, sf_dir)
    e = table(spark, sf_dir, "extracted_events").where("place_name_raw IS NOT NULL").select("place_name_raw", F.col("llm_raw.oblast").alias("hint"))
    return similarity.match_names(e, "place_name_raw", "hint", g, "blob", "oblast", regions)


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest events without a place, each with up to five candidates: those of the region hinted at first."""
    g, regions = _gazetteer(spark, sf_dir)
    e = events(spark, sf_dir, "place_name_raw llm_raw", "geom IS NULL AND gazetteer_id IS NULL AND place_name_raw IS NOT NULL").orderBy(F.desc("id")).limit(50)
    ask = e.select("id", similarity.name_key(F.col("place_name_raw")).alias("query"), similarity.canonical_region(F.col("llm_raw.oblast"), regions).alias("oblast"))
    hinted = similarity.similar(ask, "query", g, "id", "blob", "population", 0.3, 5, "oblast").join(ask, ["query", "oblast"]).select("id", "entry", "score", F.lit(0).alias("wide"))
    wide = similarity.similar(ask, "query", g, "id", "blob", "population", 0.3, 5).join(ask, "query").select("id", "entry", "score", F.lit(1).alias("wide"))
    both = hinted.unionByName(wide).groupBy("id", "entry").agg(F.max("score").alias("score"), F.min("wide").alias("wide"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("wide", F.desc("score"), "entry"))
    return both.withColumn("rank", rank).where("rank <= 5").select("id", "rank", "entry", F.round("score", 4).alias("score"), "wide")


_ALL = ((top_clusters, Q_TOP), (timeline_span, Q_SPAN), (missing_days, Q_MISSING), (stale_claims, Q_STALE), (failing_sources, Q_FAILING), (coerced_events, Q_COERCED), (item_ages, Q_AGES), (hinted_places, None), (review_queue, None))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: q for f, q in _ALL if q}
