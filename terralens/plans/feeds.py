"""Queries of filters, feeds, pairs and reports that serve a reader or a reviewer, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralens.functions import text
from terralens.io import table
from terralens.operators import clusters, relational as rel, spatial
from terralens.plans.serving import _ELL, DAY, EV, MASK, NEWS, NOW_S, REP, SRC, STAR, _near_in_time, _pts, _reports, events, news, sec, sources, star

#: Region of interest (south, north, west, east); confidence below which an event doesn't count.
REGION, FLOOR = (43.0, 53.6, 21.0, 41.4), 0.4
EVIDENCE = ("debunk", "geolocation_proof")
_EV_IN = "('debunk','geolocation_proof')"


# ---- filters


def event_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a window by the time they happened, or else were recorded."""
    e = table(spark, sf_dir, "extracted_events").select("id", sec(F.coalesce("occurred_at", "created_at")).alias("at_s")).distinct()
    return e.where(F.col("at_s").between(NOW_S - 60 * DAY, NOW_S))


Q_INSTANTS = f"SELECT DISTINCT id, CAST(floor(epoch(coalesce(occurred_at, created_at))) AS BIGINT) AS at_s FROM extracted_events WHERE at_s BETWEEN {NOW_S - 60 * DAY} AND {NOW_S}"


def region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event lies in the region of interest; no point is outside."""
    s, n, w, e = REGION
    return events(spark, sf_dir, "lon lat").select("id", F.coalesce(F.col("lat").between(s, n) & F.col("lon").between(w, e), F.lit(False)).alias("inside"))


Q_REGION = f"SELECT DISTINCT id, coalesce(lat BETWEEN {REGION[0]} AND {REGION[1]} AND lon BETWEEN {REGION[2]} AND {REGION[3]}, FALSE) AS inside FROM extracted_events"


def tier_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible items of sources of the two best tiers."""
    return news(spark, sf_dir).where("visible").select("id", "source_id").join(sources(spark, sf_dir).where("tier <= 2").select("source_id", "tier"), "source_id").select("id", "tier")


Q_TIER = f"WITH {SRC} SELECT id, tier FROM news_items JOIN src USING (source_id) WHERE visible AND tier <= 2"


def confident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with at least the least confidence; one that isn't known passes."""
    return events(spark, sf_dir, "event_type confidence", F.coalesce(F.col("confidence") >= FLOOR, F.lit(True))).select("id", "event_type")


Q_CONFIDENT = f"SELECT DISTINCT id, event_type FROM extracted_events WHERE coalesce(confidence >= {FLOOR}, TRUE)"


def items_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose body, case and white space aside, is not empty and not just the title."""
    plain = lambda c: F.lower(text.strip(text.squeeze(F.coalesce(c, F.lit("")))))
    return news(spark, sf_dir).where((plain("body") != "") & (plain("body") != plain("title"))).select("id")


_WS = r"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\s\p{{Z}}\x0b\x{{0085}}]+', ' ', 'g'), '^ | $', '', 'g')"
Q_CONTENT = f"SELECT id FROM news_items WHERE {_WS.format(c='body')} <> '' AND {_WS.format(c='body')} <> {_WS.format(c='title')}"


def placeable_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest events with a place name but neither point nor entry (the limit is the feature)."""
    e = events(spark, sf_dir, "place_name_raw", "geom IS NULL AND place_name_raw IS NOT NULL AND gazetteer_id IS NULL")
    return e.orderBy(F.desc("id")).limit(200)


Q_PLACEABLE = "SELECT DISTINCT id, place_name_raw FROM extracted_events WHERE geom IS NULL AND place_name_raw IS NOT NULL AND gazetteer_id IS NULL ORDER BY id DESC LIMIT 200"


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by a part of their name and by perspective."""
    return sources(spark, sf_dir).where(F.col("source_name").ilike("%канал%") | (F.col("perspective") == "western")).select("source_id", "source_name", "perspective", "tier").limit(500)


Q_SOURCES = f"WITH {SRC} SELECT source_id, source_name, perspective, tier FROM src WHERE source_name ILIKE '%канал%' OR perspective = 'western' LIMIT 500"


# ---- pages and feeds


def news_id_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a hundred items before an id, with the cursor of the next page (null on the last)."""
    page = news(spark, sf_dir).where("visible AND id < 1000000").select("id", "source_id").orderBy(F.desc("id")).limit(100)
    everything = Window.partitionBy(F.lit(1))
    return page.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(everything) == 100, F.min("id").over(everything)))


Q_ID_PAGE = "WITH p AS (SELECT id, source_id FROM news_items WHERE visible AND id < 1000000 ORDER BY id DESC LIMIT 100) SELECT id, source_id, CASE WHEN count(*) OVER () = 100 THEN min(id) OVER () END AS next_cursor FROM p"


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 90 items to work on: never tried ones before failed ones, the newest first."""
    n = news(spark, sf_dir).where(F.col("llm_status").isin("pending", "failed")).select("id", "llm_status", (F.col("llm_status") == "failed").cast("int").alias("attempts"))
    return n.orderBy("attempts", F.desc("id")).limit(90)


Q_QUEUE = "SELECT id, llm_status, CAST(llm_status = 'failed' AS INTEGER) AS attempts FROM news_items WHERE llm_status IN ('pending','failed') ORDER BY attempts, id DESC LIMIT 90"


def evidence_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 events in the order in which they are clustered: those that are evidence only come last."""
    e = events(spark, sf_dir, "event_type occurred_s", "visible AND occurred_at IS NOT NULL").withColumn("evidence", F.col("event_type").isin(*EVIDENCE))
    return e.orderBy("evidence", "occurred_s", "id").limit(300).select("id", "event_type", "evidence")


Q_EVIDENCE = f"WITH {EV} SELECT id, event_type, event_type IN {_EV_IN} AS evidence FROM ev WHERE visible AND occurred_at IS NOT NULL ORDER BY evidence, occurred_s, id LIMIT 300"


def merged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of reports and items by time, a report before the items of its second."""
    r = _reports(spark, sf_dir).where("visible AND last_reported_at IS NOT NULL").select("id", F.col("last_s").alias("at_s"))
    return rel.merged_feed(r, news(spark, sf_dir).where("visible AND fetched_at IS NOT NULL").select("id", F.col("fetched_s").alias("at_s")), "at_s", "id", 200).select("id", "at_s", "feed")


Q_MERGED = f"WITH {REP}, {NEWS} SELECT id, at_s, feed FROM (SELECT id, last_s AS at_s, 0 AS feed FROM rep WHERE visible AND last_reported_at IS NOT NULL UNION ALL SELECT id, fetched_s, 1 FROM nw WHERE visible AND fetched_at IS NOT NULL) ORDER BY at_s DESC, feed, id DESC LIMIT 200"


def feed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to put before those shown (the older half of the table): unknown and not older than the newest shown."""
    n = news(spark, sf_dir).where("fetched_at IS NOT NULL").select("id", "fetched_s")
    return rel.unseen(n, n.where(f"fetched_s < {NOW_S}"), "fetched_s", "id")


Q_REFRESH = f"WITH {NEWS}, s AS (SELECT id, fetched_s FROM nw WHERE fetched_s < {NOW_S}) SELECT id, fetched_s FROM nw WHERE fetched_at IS NOT NULL AND id NOT IN (SELECT id FROM s) AND fetched_s >= (SELECT coalesce(max(fetched_s), -9e18) FROM s)"


def stacked_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved events (a list of ids) of the feed, each place once, the newest on top."""
    saved = table(spark, sf_dir, "synthesized_reports").where("gazetteer_id IS NOT NULL").select("gazetteer_id").distinct()
    e = events(spark, sf_dir, "gazetteer_id occurred_s", "visible AND occurred_at IS NOT NULL AND gazetteer_id IS NOT NULL").join(saved, "gazetteer_id", "left_semi")
    return e.groupBy("gazetteer_id").agg(F.max(F.struct("occurred_s", "id")).alias("b"), F.count(F.lit(1)).alias("stack")).select("gazetteer_id", F.col("b.id").alias("id"), "stack")


Q_STACK = f"WITH {EV} SELECT gazetteer_id, arg_max(id, (occurred_s, id)) AS id, count(*) AS stack FROM ev WHERE visible AND occurred_at IS NOT NULL AND gazetteer_id IN (SELECT gazetteer_id FROM synthesized_reports) GROUP BY 1"


# ---- pairs


def nearest_report(spark: SparkSession, sf_dir: str, radius_m: float = 3000.0, slack_s: int = DAY) -> DataFrame:
    """For each event the nearest report of its type within the radius whose time it is at most the slack off; the smallest id of equally near ones."""
    near = _near_in_time(spark, sf_dir, radius_m, slack_s)
    best = near.groupBy("event_id").agg(F.min(F.struct("dist_m", "report_id")).alias("b"))
    return best.select("event_id", "b.report_id", F.round("b.dist_m", 2).alias("dist_m"))


def nearest_report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest_report`` within 60 km and 60 days."""
    return nearest_report(spark, sf_dir, 60000.0, 60 * DAY)


def _nearest_sql(radius_m: float, slack_s: int) -> str:
    return f"WITH {EV}, {REP}, p AS (SELECT e.id AS event_id, r.id AS report_id, {_ELL.format(a='r', b='e')} AS d FROM ev e JOIN rep r ON e.event_type = r.event_type AND e.occurred_s BETWEEN r.first_s - {slack_s} AND r.last_s + {slack_s} AND abs(e.lat - r.lat) < {radius_m / 1e5} AND {_ELL.format(a='r', b='e')} <= {radius_m}) SELECT event_id, report_id, round(d, 2) AS dist_m FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, report_id) = 1"


Q_NEAREST, Q_NEAREST_WIDE = _nearest_sql(3000.0, DAY), _nearest_sql(60000.0, 60 * DAY)


def debunks_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debunks with the other events of their settlement that were recorded in the 30 days before: months are part of the key."""
    e = table(spark, sf_dir, "extracted_events").where("gazetteer_id IS NOT NULL").select("id", "gazetteer_id", "event_type", sec("created_at").alias("at")).distinct()
    month = 30 * DAY
    d = e.where("event_type = 'debunk'").select("gazetteer_id", F.col("id").alias("debunk_id"), F.col("at").alias("d_at")).withColumn("m", F.explode(F.array(F.floor(F.col("d_at") / month), F.floor(F.col("d_at") / month) - 1)))
    o = e.where("event_type <> 'debunk'").withColumn("m", F.floor(F.col("at") / month))
    return d.join(o, ["gazetteer_id", "m"]).where(F.col("at").between(F.col("d_at") - month, F.col("d_at"))).select("debunk_id", F.col("id").alias("event_id"), "gazetteer_id")


Q_SAME_PLACE = f"WITH e AS (SELECT DISTINCT id, gazetteer_id, event_type, CAST(floor(epoch(created_at)) AS BIGINT) AS at FROM extracted_events) SELECT d.id AS debunk_id, o.id AS event_id, d.gazetteer_id FROM e d JOIN e o ON d.event_type = 'debunk' AND o.event_type <> 'debunk' AND d.gazetteer_id = o.gazetteer_id AND o.at BETWEEN d.at - {30 * DAY} AND d.at"


def debunk_proof_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debunks and proofs at most 10 km apart: the events with themselves, by type."""
    e = _pts(spark, sf_dir, "extracted_events", "id", "event_type")
    d, p = e.where("event_type = 'debunk'").withColumnRenamed("id", "debunk_id"), e.where("event_type = 'geolocation_proof'").withColumnRenamed("id", "proof_id")
    return spatial.distance_join(d, p, "debunk_id", "proof_id", 10000.0, spatial.ellipsoid_m).select("debunk_id", "proof_id", F.round("dist_m", 2).alias("dist_m"))


Q_PROOFS = f"WITH {EV} SELECT a.id AS debunk_id, b.id AS proof_id, round({_ELL.format(a='a', b='b')}, 2) AS dist_m FROM ev a JOIN ev b ON a.event_type = 'debunk' AND b.event_type = 'geolocation_proof' AND abs(a.lat - b.lat) < 0.11 AND {_ELL.format(a='a', b='b')} <= 10000"


def first_event_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its first event and the number of its events: scalars of a subquery as one aggregation."""
    e = events(spark, sf_dir, "news_item_id event_type").groupBy(F.col("news_item_id").alias("id")).agg(F.min(F.struct(F.col("id").alias("e"), "event_type")).alias("b"), F.count(F.lit(1)).alias("n"))
    return news(spark, sf_dir).select("id").join(e, "id", "left").select("id", F.col("b.e").alias("first_event"), F.col("b.event_type").alias("first_type"), F.coalesce("n", F.lit(0)).alias("n_events"))


Q_FIRST = f"WITH {EV} SELECT n.id, (SELECT min(e.id) FROM ev e WHERE e.news_item_id = n.id) AS first_event, (SELECT arg_min(e.event_type, e.id) FROM ev e WHERE e.news_item_id = n.id) AS first_type, (SELECT count(*) FROM ev e WHERE e.news_item_id = n.id) AS n_events FROM news_items n"


def since_latest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the latest change of any claim, a scalar subquery."""
    latest = table(spark, sf_dir, "frontline_claims").agg(F.max(sec("updated_at"))).scalar()
    e = events(spark, sf_dir, "occurred_s", "occurred_at IS NOT NULL")
    return e.where(F.col("occurred_s") > latest).select("id", (F.col("occurred_s") - latest).alias("after_s"))


Q_SINCE = f"WITH {EV}, t AS (SELECT CAST(floor(epoch(max(updated_at))) AS BIGINT) AS latest_s FROM frontline_claims) SELECT id, occurred_s - latest_s AS after_s FROM ev, t WHERE occurred_s > latest_s"


def claims_near_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims at most 30 km from the border of an active zone, with the distance to it."""
    c = _pts(spark, sf_dir, "frontline_claims", "claim_id")
    zones = table(spark, sf_dir, "blackout_zones").where("active").select(F.col("id").alias("zone"), "geom")
    return spatial.boundary_m(c, zones, "claim_id", "zone", 30000.0).select("claim_id", "zone", F.round("dist_m", 1).alias("dist_m"))


_N, _E = "(pi() / 180 * 6378137.0 * (1 - 0.0066943799901413165) / pow(sqrt(1 - 0.0066943799901413165 * pow(sin(radians(y)), 2)), 3))", "(pi() / 180 * 6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(y)), 2)) * cos(radians(y)))"
Q_BORDER = f"""WITH {EV}, {MASK}, p AS (SELECT DISTINCT id AS claim_id, lon AS x, lat AS y FROM frontline_claims WHERE lon IS NOT NULL),
v AS (SELECT claim_id, zone, (x2 - x1) * {_E} AS ux, (y2 - y1) * {_N} AS uy, (x - x1) * {_E} AS px, (y - y1) * {_N} AS py FROM p JOIN edges ON y BETWEEN least(y1, y2) - 0.4 AND greatest(y1, y2) + 0.4 WHERE x1 <> x2 OR y1 <> y2),
t AS (SELECT *, least(1.0, greatest(0.0, (ux * px + uy * py) / (ux * ux + uy * uy))) AS t FROM v),
d AS (SELECT claim_id, zone, min(sqrt(pow(px - t * ux, 2) + pow(py - t * uy, 2))) AS d FROM t GROUP BY 1, 2)
SELECT claim_id, zone, round(d, 1) AS dist_m FROM d WHERE d <= 30000"""


# ---- groups


def disputed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with whether any of their events is a debunk, and any a proof."""
    g = events(spark, sf_dir, "news_item_id event_type").groupBy("news_item_id")
    return g.agg(*[F.coalesce(F.bool_or(F.col("event_type") == k), F.lit(False)).alias(f"any_{k}") for k in EVIDENCE])


Q_DISPUTED = f"WITH {EV} SELECT news_item_id, coalesce(bool_or(event_type = 'debunk'), FALSE) AS any_debunk, coalesce(bool_or(event_type = 'geolocation_proof'), FALSE) AS any_geolocation_proof FROM ev GROUP BY 1"


def disputed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with whether any event of its item is a debunk."""
    e = events(spark, sf_dir, "news_item_id event_type", "news_item_id IS NOT NULL")
    return e.select("id", F.coalesce(F.bool_or(F.col("event_type") == "debunk").over(Window.partitionBy("news_item_id")), F.lit(False)).alias("disputed"))


Q_OVER = f"WITH {EV} SELECT id, coalesce(bool_or(event_type = 'debunk') OVER (PARTITION BY news_item_id), FALSE) AS disputed FROM ev WHERE news_item_id IS NOT NULL"


def news_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visible item with its events as a JSON array in order of id, an empty one if it has none."""
    one = F.struct("id", F.coalesce("event_type", F.lit("")).alias("type"), F.coalesce("lon", F.lit(0.0)).alias("lon"))
    e = events(spark, sf_dir, "news_item_id event_type lon", "visible").groupBy(F.col("news_item_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("events"))
    return news(spark, sf_dir).where("visible").select("id").join(e, "id", "left").select("id", F.coalesce("events", F.lit("[]")).alias("events"))


Q_JSON = f"WITH {EV} SELECT n.id, CAST(coalesce(to_json(list({{'id': e.id, 'type': coalesce(e.event_type, ''), 'lon': coalesce(e.lon, 0.0)}} ORDER BY e.id) FILTER (e.id IS NOT NULL)), '[]') AS VARCHAR) AS events FROM news_items n LEFT JOIN ev e ON e.news_item_id = n.id AND e.visible WHERE n.visible GROUP BY n.id"


def intake_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of items and events came to, one counter a row."""
    n = news(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"), F.count_if("visible").alias("visible"), F.count_if(F.col("body").isNull()).alias("no_body"), F.count_if(F.col("published_at").isNull()).alias("no_stamp"))
    e = events(spark, sf_dir, "lon gazetteer_id").agg(F.count(F.lit(1)).alias("events"), F.count("lon").alias("placed"), F.count_if(F.expr("lon IS NULL AND gazetteer_id IS NULL")).alias("unplaced"))
    wide = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("counter", "n"))
    return wide(n).unionByName(wide(e))


Q_COUNTERS = f"WITH {EV}, n AS (SELECT count(*) AS items, count(*) FILTER (visible) AS visible, count(*) FILTER (body IS NULL) AS no_body, count(*) FILTER (published_at IS NULL) AS no_stamp FROM news_items), e AS (SELECT count(*) AS events, count(lon) AS placed, count(*) FILTER (lon IS NULL AND gazetteer_id IS NULL) AS unplaced FROM ev) " + " UNION ALL ".join(f"SELECT '{c}' AS counter, {c} AS n FROM {t}" for t, cs in (("n", "items visible no_body no_stamp"), ("e", "events placed unplaced")) for c in cs.split())


def reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that are dropped from the layers, counted by the first word of their reason."""
    z = table(spark, sf_dir, "blackout_zones").where("NOT active")
    return z.groupBy(F.coalesce(F.nullif(F.regexp_extract(F.lower("reason"), r"^(\w+)", 1), F.lit("")), F.lit("none")).alias("token")).agg(F.count(F.lit(1)).alias("dropped"))


Q_TALLY = r"SELECT coalesce(nullif(regexp_extract(lower(reason), '^(\w+)', 1), ''), 'none') AS token, count(*) AS dropped FROM blackout_zones WHERE NOT active GROUP BY 1"


def peak_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by week, each as a share of the fullest."""
    e = events(spark, sf_dir, "occurred_s", "visible AND occurred_at IS NOT NULL").groupBy(F.floor(F.col("occurred_s") / (7 * DAY)).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("week", "n", F.round(F.col("n") / e.agg(F.max("n")).scalar(), 4).alias("height"))


Q_PEAK = f"WITH {EV}, h AS (SELECT occurred_s // {7 * DAY} AS week, count(*) AS n FROM ev WHERE visible AND occurred_at IS NOT NULL GROUP BY 1) SELECT week, n, round(n / (max(n) OVER ()), 4) AS height FROM h"


# ---- values


def truncated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies cut at 400 characters with an ellipsis."""
    return news(spark, sf_dir).where("body IS NOT NULL").select("id", text.truncated(F.col("body"), 400).alias("body"))


Q_TRUNCATED = "SELECT id, CASE WHEN length(body) > 400 THEN rtrim(substr(body, 1, 400), ' ') || ' …' ELSE body END AS body FROM news_items WHERE body IS NOT NULL"


def item_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel name in an item's address and the number in its external id."""
    number = text.post_number(F.replace("external_id", F.lit("-"), F.lit("/")))
    return news(spark, sf_dir).where("url IS NOT NULL").select("id", text.slug_of(F.col("url")).alias("slug"), number.alias("number"))


Q_SLUGS = r"SELECT id, nullif(regexp_extract(url, '^(?:https?://)?[^/\s]+/(?:s/)?([A-Za-z0-9_]+)', 1), '') AS slug, TRY_CAST(split_part(external_id, '-', -1) AS BIGINT) AS number FROM news_items WHERE url IS NOT NULL"


def positional_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of losses, each with the coordinate of its position in ``geo``, the last one where there are fewer."""
    w = table(spark, sf_dir, "warspotting_recent").where("geo IS NOT NULL AND tags IS NOT NULL").select("id", "tags", text.coordinates(F.col("geo")).alias("c")).where("size(c) > 0").distinct()
    rows = w.select("id", "c", F.posexplode(F.split("tags", ",")).alias("i", "tag"))
    at = F.element_at("c", F.least(F.col("i") + 1, F.size("c")))
    return rows.select("id", "i", F.trim("tag").alias("tag"), at["lat"].alias("lat"), at["lon"].alias("lon"))


Q_POSITIONAL = r"""WITH w AS (SELECT DISTINCT id, tags, regexp_extract(geo, '(\d{1,2}\.\d{3,})\s*[,;/ ]\s*(\d{1,2}\.\d{3,})', ['a', 'b']) AS g FROM warspotting_recent WHERE geo IS NOT NULL AND tags IS NOT NULL AND regexp_matches(geo, '\d{1,2}\.\d{3,}\s*[,;/ ]\s*\d{1,2}\.\d{3,}')),
t AS (SELECT id, g, string_split(tags, ',') AS ts FROM w), x AS (SELECT id, g, unnest(ts) AS tag, generate_subscripts(ts, 1) - 1 AS i FROM t)
SELECT id, CAST(i AS INTEGER) AS i, trim(tag) AS tag, CAST(g.a AS DOUBLE) AS lat, CAST(g.b AS DOUBLE) AS lon FROM x"""


def merged_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a map of remarks, merged with newer remarks on every third: new entries win, the others stay."""
    s = sources(spark, sf_dir).select("source_id", "source_name", F.create_map(F.lit("view"), F.col("perspective"), F.lit("tier"), F.col("tier").cast("string")).alias("meta"))
    new = sources(spark, sf_dir).where("source_id % 3 = 0").select("source_id", F.lit("renamed").alias("source_name"), F.create_map(F.lit("tier"), F.lit("9"), F.lit("by"), F.lit("hand")).alias("meta"))
    out = rel.upsert_maps(s, new, ["source_id"], ["meta"], ["source_name"])
    return out.select("source_id", "source_name", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("meta"))


Q_META = f"WITH {SRC} SELECT source_id, source_name, CASE WHEN source_id % 3 = 0 THEN 'by=hand,tier=9,view=' || perspective ELSE 'tier=' || tier || ',view=' || perspective END AS meta FROM src"


def place_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports' places put into the gazetteer: the nearest entry of the same name within 3 km is the same place, others are new."""
    r = spatial.with_point(table(spark, sf_dir, "synthesized_reports").where("place_name IS NOT NULL").select(F.col("id").alias("report_id"), F.lower("place_name").alias("name"), "geom"))
    g = table(spark, sf_dir, "gazetteer").where("lat IS NOT NULL AND lon IS NOT NULL")
    names = g.select(F.col("id").alias("entry"), F.explode(F.array_distinct(F.array(*[F.lower(c) for c in ("name_uk", "name_ru", "name_en")]))).alias("name"), F.col("lon").alias("x"), F.col("lat").alias("y")).where("name IS NOT NULL")
    near = spatial.nearest_join(r, names, "report_id", "entry", 3000.0, spatial.ellipsoid_m, on=("name",))
    return r.select("report_id").distinct().join(near, "report_id", "left").select("report_id", "entry", F.when(F.col("entry").isNull(), "inserted").otherwise("updated").alias("action"))


Q_PLACE_UPSERT = f"WITH r AS (SELECT DISTINCT id AS report_id, lower(place_name) AS name, lon, lat FROM synthesized_reports WHERE place_name IS NOT NULL AND lon IS NOT NULL), g AS (SELECT DISTINCT id AS entry, unnest([lower(name_uk), lower(name_ru), lower(name_en)]) AS name, lon, lat FROM gazetteer WHERE lat IS NOT NULL AND lon IS NOT NULL), p AS (SELECT report_id, entry, {_ELL.format(a='r', b='g')} AS d FROM r JOIN g ON r.name = g.name AND {_ELL.format(a='r', b='g')} <= 3000), b AS (SELECT report_id, arg_min(entry, (d, entry)) AS entry FROM p GROUP BY 1) SELECT report_id, entry, CASE WHEN entry IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM r LEFT JOIN b USING (report_id)"


def domestic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that may be matched to a place of the list: those said to lie in another country are not."""
    e = table(spark, sf_dir, "extracted_events").where(F.coalesce(F.lower(F.trim(F.col("llm_raw.country"))), F.lit("ua")).isin("ua", ""))
    return e.where("place_name_raw IS NOT NULL").select("id", "place_name_raw").distinct()


Q_DOMESTIC = "SELECT DISTINCT id, place_name_raw FROM extracted_events WHERE coalesce(lower(trim(llm_raw.country)), 'ua') IN ('ua', '') AND place_name_raw IS NOT NULL"


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geolocated records as items and their events in one: title, content hash and point; copies once, records without a point dropped."""
    g = table(spark, sf_dir, "geoconfirmed_head").where("Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180").select("Id", "Name", "Description", "Latitude", "Longitude").distinct()
    title = F.substring(F.coalesce(F.nullif(F.trim("Name"), F.lit("")), F.col("Id")), 1, 200)
    return g.select(F.col("Id").alias("external_id"), title.alias("title"), text.content_hash(title, F.col("Description")).alias("hash"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.lit("geolocation_proof").alias("event_type"))


_CLEAN = r"regexp_replace({c}, '^[\s\p{{Z}}\x0b\x{{0085}}]+|[\s\p{{Z}}\x0b\x{{0085}}]+$', '', 'g')"
Q_RECORDS = r"""WITH g AS (SELECT DISTINCT Id, substr(coalesce(nullif(trim(Name, ' '), ''), Id), 1, 200) AS title, Description, Latitude, Longitude FROM geoconfirmed_head WHERE Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180)
SELECT Id AS external_id, title, sha256(lower(regexp_replace(""" + _CLEAN.format(c="title || chr(10) || " + _CLEAN.format(c="coalesce(Description, '')")) + r""", '[\s\p{Z}\x0b\x{0085}]+', ' ', 'g'))) AS hash, Latitude AS lat, Longitude AS lon, 'geolocation_proof' AS event_type FROM g"""


def story_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to delete because their story (source and external id) has a newer version than the item they come from."""
    n = news(spark, sf_dir).where("external_id IS NOT NULL").select("id", "source_id", "external_id", "fetched_s")
    newest = n.groupBy("source_id", "external_id").agg(F.max(F.struct("fetched_s", "id")).alias("b")).select("source_id", "external_id", F.col("b.id").alias("newest"))
    old = n.join(newest, ["source_id", "external_id"]).where("id <> newest").select(F.col("id").alias("news_item_id"), "newest")
    return events(spark, sf_dir, "news_item_id").join(old, "news_item_id").select("id", "news_item_id", "newest")


Q_RESETS = f"WITH {EV}, {NEWS}, v AS (SELECT id, first_value(id) OVER (PARTITION BY source_id, external_id ORDER BY fetched_s DESC NULLS LAST, id DESC) AS newest FROM nw WHERE external_id IS NOT NULL) SELECT ev.id, news_item_id, newest FROM ev JOIN v ON v.id = news_item_id WHERE v.id <> newest"


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of evidence of each claim: visible events within 10 km with their item, source and side, in order of time."""
    c = _pts(spark, sf_dir, "frontline_claims", "claim_id")
    e = _pts(spark, sf_dir, "extracted_events", "event_id", "visible").where("visible")
    near = spatial.distance_join(c, e, "claim_id", "event_id", 10000.0, spatial.ellipsoid_m)
    chain = near.join(star(spark, sf_dir, "occurred_s").withColumnRenamed("id", "event_id"), "event_id")
    step = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.asc_nulls_last("occurred_s"), "event_id"))
    return chain.select("claim_id", step.alias("step"), "event_id", "news_item_id", "source_name", "side", F.round("dist_m", 2).alias("dist_m"))


Q_CHAIN = f"WITH {STAR}, p AS (SELECT c.id AS claim_id, s.*, {_ELL.format(a='c', b='s')} AS d FROM frontline_claims c JOIN star s ON abs(c.lat - s.lat) < 0.11 AND {_ELL.format(a='c', b='s')} <= 10000) SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY occurred_s NULLS LAST, id) AS INTEGER) AS step, id AS event_id, news_item_id, source_name, side, round(d, 2) AS dist_m FROM p"


def claim_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a claiming event comes to: merged with the nearest claim of its side within 25 km, or a claim of its own."""
    side = F.when(F.col("claimed_by").isin("ru", "ua"), F.concat("claimed_by", F.lit("_advance")))
    e = _pts(spark, sf_dir, "extracted_events", "event_id", "event_type", "claimed_by").where("event_type IN ('frontline_claim', 'frontline_advance')").withColumn("direction", side).where("direction IS NOT NULL")
    c = _pts(spark, sf_dir, "frontline_claims", "claim_id", "direction")
    best = spatial.nearest_join(e, c, "event_id", "claim_id", 25000.0, spatial.ellipsoid_m, on=("direction",))
    return e.select("event_id").distinct().join(best, "event_id", "left").select("event_id", "claim_id", F.when(F.col("claim_id").isNull(), "new").otherwise("merged").alias("outcome"))


Q_INTAKE = f"WITH {EV}, e AS (SELECT id, lon, lat, claimed_by || '_advance' AS direction FROM ev WHERE event_type IN ('frontline_claim', 'frontline_advance') AND claimed_by IN ('ru', 'ua') AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), p AS (SELECT e.id AS event_id, c.id AS claim_id, {_ELL.format(a='e', b='c')} AS d FROM e JOIN frontline_claims c ON c.direction = e.direction AND abs(c.lat - e.lat) < 0.27 AND {_ELL.format(a='e', b='c')} <= 25000), b AS (SELECT event_id, arg_min(claim_id, (d, claim_id)) AS claim_id FROM p GROUP BY 1) SELECT e.id AS event_id, claim_id, CASE WHEN claim_id IS NULL THEN 'new' ELSE 'merged' END AS outcome FROM e LEFT JOIN b ON b.event_id = e.id"


# ---- clusters


def report_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that chain up in space and time: one type, at most 3 km and a day from link to link; with the class's size and each event's links."""
    e = _pts(spark, sf_dir, "extracted_events", "id", "event_type", "occurred_at", "visible").where("visible").withColumn("at", sec("occurred_at"))
    return clusters.space_time_clusters(e, "id", "event_type", "at", 3000.0, DAY)


Q_CLUSTERS = f"""WITH RECURSIVE {EV}, n AS (SELECT DISTINCT id, event_type, lon, lat, occurred_s FROM ev WHERE visible AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND occurred_s IS NOT NULL AND event_type IS NOT NULL),
l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.event_type = b.event_type AND a.id <> b.id AND abs(a.occurred_s - b.occurred_s) <= {DAY} AND abs(a.lat - b.lat) < 0.04 AND {_ELL.format(a='a', b='b')} <= 3000),
r AS (SELECT id, id AS reached FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS cluster, count(DISTINCT reached) AS members FROM r GROUP BY 1)
SELECT id, cluster, members, (SELECT count(*) FROM l WHERE l.a = c.id) AS links FROM c"""

_ALL = (
    (event_instants, Q_INSTANTS), (region_gate, Q_REGION), (tier_ceiling, Q_TIER), (confident_events, Q_CONFIDENT), (items_with_content, Q_CONTENT), (placeable_pending, Q_PLACEABLE), (source_list, Q_SOURCES), (news_id_page, Q_ID_PAGE),
    (work_queue, Q_QUEUE), (evidence_last, Q_EVIDENCE), (merged_page, Q_MERGED), (feed_refresh, Q_REFRESH), (stacked_shortlist, Q_STACK), (nearest_report, Q_NEAREST), (nearest_report_wide, Q_NEAREST_WIDE), (debunks_of_place, Q_SAME_PLACE), (debunk_proof_pairs, Q_PROOFS),
    (first_event_of_item, Q_FIRST), (since_latest_claim, Q_SINCE), (claims_near_border, Q_BORDER), (disputed_items, Q_DISPUTED), (disputed_events, Q_OVER), (news_events_json, Q_JSON), (intake_counters, Q_COUNTERS), (reason_tally, Q_TALLY),
    (peak_histogram, Q_PEAK), (truncated_bodies, Q_TRUNCATED), (item_slugs, Q_SLUGS), (positional_points, Q_POSITIONAL), (merged_meta, Q_META), (place_upsert, Q_PLACE_UPSERT), (domestic_events, Q_DOMESTIC), (record_events, Q_RECORDS), (story_resets, Q_RESETS), (claim_evidence, Q_CHAIN), (claim_intake, Q_INTAKE), (report_clusters, Q_CLUSTERS),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: q for f, q in _ALL if q}
