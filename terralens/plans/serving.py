"""Queries over items, events, reports and claims, each beside its SQL.

Sources have no table of their own here; their perspective and reliability tier are derived from ``source_id``
(``sources`` below and the same expressions in SQL). Times are whole seconds since 1970 where a result holds them, so
that no session time zone matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions import text
from terralens.io import table
from terralens.operators import relational as rel
from terralens.operators import spatial
from terralens.plans.analysis_sql import COORDINATES

FROM_S, TO_S = 1709251200, 1717200000  # 2024-03-01 and 2024-06-01
NOW_S = 1735689600  # 2025-01-01
BOX = (24.0, 45.5, 38.5, 50.5)
DAY = 86400
#: Places above which an item is a digest; tokens that one request may hold.
DIGEST_PLACES, PACK_TOKENS = 5, 4000


def sec(c: str | Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id, source_name, perspective, side, tier``."""
    views = F.array(*[F.lit(x) for x in ("ukrainian", "russian", "western", "neutral")])
    return table(spark, sf_dir, "source_clock").select(
        "source_id", F.col("name").alias("source_name"), views[F.pmod("source_id", F.lit(4))].alias("perspective"),
        F.when(F.pmod("source_id", F.lit(4)) >= 2, "western").otherwise(views[F.pmod("source_id", F.lit(4))]).alias("side"), (F.pmod("source_id", F.lit(3)) + 1).cast("int").alias("tier"),
    )


SRC = """src AS (SELECT source_id, name AS source_name, (['ukrainian','russian','western','neutral'])[source_id % 4 + 1] AS perspective,
  CASE WHEN source_id % 4 >= 2 THEN 'western' ELSE (['ukrainian','russian'])[source_id % 4 + 1] END AS side, CAST(source_id % 3 + 1 AS INTEGER) AS tier FROM source_clock)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ``fetched_s`` for their time; the raw publication stamp is the business of another operator."""
    return table(spark, sf_dir, "news_items").withColumn("fetched_s", sec("fetched_at"))


def events(spark: SparkSession, sf_dir: str, columns: str, where: str | Column | None = None) -> DataFrame:
    """The given columns (``id`` and ``occurred_s`` among those there are) of the events that ``where`` lets pass, exact duplicate rows once.

    Filter and projection come before the duplicates are dropped, so both reach the scan and only these columns are shuffled.
    """
    e = table(spark, sf_dir, "extracted_events")
    if where is not None:
        e = e.where(where)
    names = columns.split()
    return e.select("id", *[c for c in names if c not in ("id", "occurred_s")], *[sec("occurred_at").alias(c) for c in names if c == "occurred_s"]).distinct()


EV = "ev AS (SELECT DISTINCT *, CAST(floor(epoch(occurred_at)) AS BIGINT) AS occurred_s FROM extracted_events)"
NEWS = "nw AS (SELECT *, CAST(floor(epoch(fetched_at)) AS BIGINT) AS fetched_s FROM news_items)"


def star(spark: SparkSession, sf_dir: str, columns: str, where: str | Column = "visible") -> DataFrame:
    """Visible events (their given columns, those that ``where`` lets pass) with their visible items and sources.

    The list of sources is small by its file's size, which Spark checks before it broadcasts it.
    """
    n = news(spark, sf_dir).where("visible").select(F.col("id").alias("news_item_id"), "source_id", "title", "lang", "fetched_s")
    e = events(spark, sf_dir, f"news_item_id {columns}", where).join(n, "news_item_id")
    return e.join(sources(spark, sf_dir), "source_id")


STAR = f"{SRC}, {EV}, {NEWS}, star AS (SELECT ev.*, nw.source_id, nw.title, nw.lang, nw.fetched_s, src.source_name, src.perspective, src.side, src.tier FROM ev JOIN nw ON nw.id = ev.news_item_id JOIN src USING (source_id) WHERE ev.visible AND nw.visible)"


# ---- points, clusters, masks


def events_points_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest thousand placed events of a window, a box, some types and perspectives (the limit is the feature)."""
    at = F.col("occurred_at").between(F.timestamp_seconds(F.lit(FROM_S)), F.timestamp_seconds(F.lit(TO_S + 1))) & sec("occurred_at").between(FROM_S, TO_S)
    kept = F.col("visible") & at & F.col("event_type").isin("shelling", "deep_strike", "frontline_claim") & rel.in_box(F.col("lon"), F.col("lat"), BOX)
    df = rel.where_all(star(spark, sf_dir, "event_type lon lat occurred_s place_name_raw", kept), F.col("perspective").isin("ukrainian", "western"))
    out = df.select("id", "event_type", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "occurred_s", "perspective", text.display(F.col("place_name_raw"), F.col("title")).alias("label"))
    return out.orderBy(F.desc("occurred_s"), F.desc("id")).limit(1000)


Q_POINTS = f"""WITH {STAR} SELECT id, event_type, round(lon, 5) AS lon, round(lat, 5) AS lat, occurred_s, perspective, coalesce(nullif(place_name_raw, ''), title) AS label FROM star
WHERE occurred_s BETWEEN {FROM_S} AND {TO_S} AND event_type IN ('shelling','deep_strike','frontline_claim') AND perspective IN ('ukrainian','western') AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}
ORDER BY occurred_s DESC, id DESC LIMIT 1000"""


def events_grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by grid cell with conditional counts and the damped share of one side."""
    kinds = {f"n_{k}": F.col("event_type") == k for k in ("shelling", "deep_strike", "debunk")} | {f"n_{k}": F.col("side") == k for k in ("ukrainian", "russian", "western")}
    cells = rel.grid_clusters(star(spark, sf_dir, "event_type lon lat", "visible AND lon IS NOT NULL"), 6, kinds)
    return cells.withColumn("lean", rel.damped_share(F.col("n_russian"), F.col("n_ukrainian")))


Q_GRID = f"""WITH {STAR} SELECT CAST(round_even(lon / 0.25, 0) AS BIGINT) AS cx, CAST(round_even(lat / 0.25, 0) AS BIGINT) AS cy, count(*) AS n, floor((sum(CAST(round_even(lon * 1e6, 0) AS BIGINT)) * 2 + count(*) * 10) / (count(*) * 20)) / 1e5 AS lon, floor((sum(CAST(round_even(lat * 1e6, 0) AS BIGINT)) * 2 + count(*) * 10) / (count(*) * 20)) / 1e5 AS lat,
round(min(lon) - 0.0625, 5) AS west, round(min(lat) - 0.0625, 5) AS south, round(max(lon) + 0.0625, 5) AS east, round(max(lat) + 0.0625, 5) AS north,
count(*) FILTER (event_type = 'shelling') AS n_shelling, count(*) FILTER (event_type = 'deep_strike') AS n_deep_strike, count(*) FILTER (event_type = 'debunk') AS n_debunk,
count(*) FILTER (side = 'ukrainian') AS n_ukrainian, count(*) FILTER (side = 'russian') AS n_russian, count(*) FILTER (side = 'western') AS n_western,
round((count(*) FILTER (side = 'russian') + 1) / CAST(count(*) FILTER (side = 'russian') + count(*) FILTER (side = 'ukrainian') + 2 AS DOUBLE), 4) AS lean FROM star WHERE lon IS NOT NULL GROUP BY 1, 2"""


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "blackout_zones").where("active").select(F.col("id").alias("zone"), "geom")
    return spatial.points_in_regions(spatial.with_point(events(spark, sf_dir, "geom", "geom IS NOT NULL")), zones, "id", "zone").select("id").distinct()


MASK = """rings AS (SELECT id AS zone, unnest(regexp_extract_all(geom, '\\(([^()]+)\\)', 1)) AS ring FROM blackout_zones WHERE active),
pos AS (SELECT zone, string_split(ring, ',') AS p FROM rings), ends AS (SELECT zone, trim(p[i]) AS a, trim(p[i + 1]) AS b FROM pos, range(1, 2000) r(i) WHERE i < len(p)),
edges AS (SELECT zone, CAST(split_part(a, ' ', 1) AS DOUBLE) AS x1, CAST(split_part(a, ' ', 2) AS DOUBLE) AS y1, CAST(split_part(b, ' ', 1) AS DOUBLE) AS x2, CAST(split_part(b, ' ', 2) AS DOUBLE) AS y2 FROM ends),
masked AS (SELECT DISTINCT id FROM (SELECT ev.id, zone FROM ev JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ev.id, zone HAVING count(*) % 2 = 1))"""


def events_blackout_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed events outside every active zone."""
    return events(spark, sf_dir, "event_type", "lon IS NOT NULL").join(_masked(spark, sf_dir), "id", "left_anti")


Q_MASK = f"WITH {EV}, {MASK} SELECT id, event_type FROM ev WHERE lon IS NOT NULL AND id NOT IN (SELECT id FROM masked)"


def news_placement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, placed if a visible event of theirs has a point."""
    placed = table(spark, sf_dir, "extracted_events").where("visible AND lon IS NOT NULL").select(F.col("news_item_id").alias("id")).distinct().withColumn("placed", F.lit(True))
    return news(spark, sf_dir).where("visible").select("id", "source_id").join(placed, "id", "left").withColumn("placed", F.coalesce("placed", F.lit(False)))


Q_PLACED = f"WITH {EV} SELECT id, source_id, EXISTS (SELECT 1 FROM ev WHERE ev.news_item_id = n.id AND ev.visible AND lon IS NOT NULL) AS placed FROM news_items n WHERE visible"


def news_blackout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left when those go whose placed events all lie in active zones; one aggregation instead of nested anti-joins."""
    e = events(spark, sf_dir, "news_item_id", "visible AND lon IS NOT NULL").join(_masked(spark, sf_dir).withColumn("m", F.lit(1)), "id", "left")
    g = e.groupBy(F.col("news_item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_placed"), F.count("m").alias("n_masked"))
    return news(spark, sf_dir).where("visible").select("id").join(g, "id", "left").fillna(0, ["n_placed", "n_masked"]).where("NOT (n_placed > 0 AND n_placed = n_masked)")


Q_BLACKOUT = f"""WITH {EV}, {MASK}, g AS (SELECT news_item_id, count(*) AS n_placed, count(m.id) AS n_masked FROM ev LEFT JOIN masked m ON m.id = ev.id WHERE visible AND lon IS NOT NULL GROUP BY 1)
SELECT n.id, coalesce(n_placed, 0) AS n_placed, coalesce(n_masked, 0) AS n_masked FROM news_items n LEFT JOIN g ON g.news_item_id = n.id WHERE visible AND NOT (coalesce(n_placed, 0) > 0 AND n_placed = n_masked)"""


# ---- feed


def news_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 items after a cursor (time, id), newest first."""
    n = news(spark, sf_dir).where("visible").select("id", "fetched_s", "title")
    return rel.keyset_page(n, F.col("fetched_s"), F.col("id"), 50, (NOW_S, 0))


Q_PAGE = f"WITH {NEWS} SELECT id, fetched_s, title FROM nw WHERE visible AND (fetched_s < {NOW_S} OR (fetched_s = {NOW_S} AND id < 0)) ORDER BY fetched_s DESC, id DESC LIMIT 50"


def news_ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a word in title or body, whatever its case; null parts don't match."""
    hit = F.coalesce(F.col("title").ilike("%вибух%"), F.lit(False)) | F.coalesce(F.col("body").ilike("%вибух%"), F.lit(False))
    return news(spark, sf_dir).where(hit).select("id", "source_id")


Q_ILIKE = "SELECT id, source_id FROM news_items WHERE coalesce(title ILIKE '%вибух%', FALSE) OR coalesce(body ILIKE '%вибух%', FALSE)"


def news_relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are processed and yet have no event at all."""
    have = table(spark, sf_dir, "extracted_events").select(F.col("news_item_id").alias("id")).distinct()
    return news(spark, sf_dir).where(F.col("llm_status").isin("done", "skipped")).select("id", "llm_status").join(have, "id", "left_anti")


Q_GATE = "SELECT id, llm_status FROM news_items n WHERE llm_status IN ('done','skipped') AND NOT EXISTS (SELECT 1 FROM extracted_events e WHERE e.news_item_id = n.id)"


def news_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and the body's first 240 characters with single spaces."""
    return news(spark, sf_dir).select("id", text.snippet(F.col("body")).alias("snippet"), text.estimated_tokens(F.col("body")).alias("tokens"))


Q_SNIPPETS = r"""WITH s AS (SELECT id, body, regexp_replace(regexp_replace(coalesce(body, ''), '[\s\p{Z}\x0b\x{0085}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM news_items)
SELECT id, CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 240), '\s+$', '') || '…' ELSE t END AS snippet, CAST(CASE WHEN length(coalesce(body, '')) > 0 THEN length(body) // 2 + 1 ELSE 0 END AS BIGINT) AS tokens FROM s"""


def news_events_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visible item with its events in order of id as one string; none gives an empty one."""
    e = events(spark, sf_dir, "news_item_id event_type", "visible").groupBy(F.col("news_item_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("e"), F.coalesce("event_type", F.lit("")).alias("t")))), lambda x: F.concat_ws(":", x["e"].cast("string"), x["t"])), ",").alias("events"), F.count(F.lit(1)).alias("n_events"))
    return news(spark, sf_dir).where("visible").select("id").join(e, "id", "left").fillna("", ["events"]).fillna(0, ["n_events"])


Q_NESTED = f"""WITH {EV} SELECT n.id, coalesce(string_agg(e.id || ':' || coalesce(e.event_type, ''), ',' ORDER BY e.id), '') AS events, count(e.id) AS n_events FROM news_items n LEFT JOIN ev e ON e.news_item_id = n.id AND e.visible WHERE n.visible GROUP BY n.id"""


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per content (case and white space aside): the first fetched, with the number of copies."""
    n = news(spark, sf_dir).select("id", "fetched_s", text.content_hash(F.col("title"), F.col("body")).alias("hash"))
    return n.groupBy("hash").agg(F.min(F.struct("fetched_s", "id")).alias("b"), F.count(F.lit(1)).alias("copies")).select(F.col("b.id").alias("id"), "hash", "copies")


Q_DEDUPE = r"""WITH h AS (SELECT id, CAST(floor(epoch(fetched_at)) AS BIGINT) AS f, sha256(lower(regexp_replace(regexp_replace(coalesce(title, '') || chr(10) || regexp_replace(coalesce(body, ''), '^[\s\p{Z}\x0b\x{0085}]+|[\s\p{Z}\x0b\x{0085}]+$', '', 'g'), '^[\s\p{Z}\x0b\x{0085}]+|[\s\p{Z}\x0b\x{0085}]+$', '', 'g'), '[\s\p{Z}\x0b\x{0085}]+', ' ', 'g'))) AS hash FROM news_items)
SELECT arg_min(id, (f, id)) AS id, hash, count(*) AS copies FROM h GROUP BY hash"""


def story_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of each story (source and external id): the newest fetched wins, with the number of versions."""
    n = news(spark, sf_dir).where("external_id IS NOT NULL").select("id", "source_id", "external_id", "fetched_s")
    w = n.groupBy("source_id", "external_id").agg(F.max(F.struct("fetched_s", "id")).alias("b"), F.count(F.lit(1)).alias("versions"))
    return w.select("source_id", "external_id", F.col("b.id").alias("id"), "versions")


Q_STORY = f"WITH {NEWS} SELECT source_id, external_id, arg_max(id, (fetched_s, id)) AS id, count(*) AS versions FROM nw WHERE external_id IS NOT NULL GROUP BY ALL"


# ---- timeline and roll-ups


def timeline_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible events of the last 400 days by UTC day."""
    since = F.col("occurred_at") >= F.timestamp_seconds(F.lit(NOW_S - 400 * DAY))
    e = events(spark, sf_dir, "occurred_s", F.col("visible") & since).where(F.col("occurred_s") <= NOW_S)
    return e.groupBy(F.floor(F.col("occurred_s") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))


Q_HIST = f"WITH {EV} SELECT occurred_s // {DAY} AS day, count(*) AS n FROM ev WHERE visible AND occurred_s BETWEEN {NOW_S - 400 * DAY} AND {NOW_S} GROUP BY 1"


def timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First percentile and last event time by type: an exact ordered-set aggregate."""
    e = events(spark, sf_dir, "news_item_id event_type occurred_s", "visible AND occurred_at IS NOT NULL")
    first = rel.percentile_disc(e, ["event_type"], "occurred_s", 0.01).select(F.col("event_type").alias("t"), F.col("occurred_s").alias("first_s"))
    g = e.groupBy("event_type").agg(F.max("occurred_s").alias("last_s"), F.countDistinct("news_item_id").alias("items"))
    return g.join(first, F.col("event_type").eqNullSafe(F.col("t"))).select("event_type", "first_s", "last_s", "items")


Q_BOUNDS = f"WITH {EV} SELECT event_type, CAST(percentile_disc(0.01) WITHIN GROUP (ORDER BY occurred_s) AS BIGINT) AS first_s, max(occurred_s) AS last_s, count(DISTINCT news_item_id) AS items FROM ev WHERE visible AND occurred_s IS NOT NULL GROUP BY 1"


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by source and status, with the time since the last arrival."""
    g = news(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("llm_status") == s).alias(f"n_{s}") for s in ("pending", "done", "skipped", "failed")], F.max("fetched_s").alias("last_s"))
    return g.join(sources(spark, sf_dir).select("source_id", "perspective", "tier"), "source_id", "left").withColumn("silent_s", F.lit(NOW_S).cast("bigint") - F.col("last_s"))


Q_ROLLUP = f"WITH {SRC}, {NEWS} SELECT source_id, count(*) AS items, count(*) FILTER (llm_status = 'pending') AS n_pending, count(*) FILTER (llm_status = 'done') AS n_done, count(*) FILTER (llm_status = 'skipped') AS n_skipped, count(*) FILTER (llm_status = 'failed') AS n_failed, max(fetched_s) AS last_s, any_value(perspective) AS perspective, any_value(tier) AS tier, {NOW_S} - max(fetched_s) AS silent_s FROM nw LEFT JOIN src USING (source_id) GROUP BY source_id"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "synthesized_reports").withColumns({"first_s": sec("first_reported_at"), "last_s": sec("last_reported_at")})


REP = "rep AS (SELECT *, CAST(floor(epoch(first_reported_at)) AS BIGINT) AS first_s, CAST(floor(epoch(last_reported_at)) AS BIGINT) AS last_s FROM synthesized_reports)"


def retention_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a compaction drops: not the last of their source and day, and old."""
    n = news(spark, sf_dir).withColumn("day", F.floor(F.col("fetched_s") / DAY))
    return rel.top_k(n, ["source_id", "day"], [F.desc("fetched_s"), F.desc("id")], 2**31 - 1).where(f"rank > 1 AND fetched_s < {NOW_S - 90 * DAY}").select("id", "source_id", "day", "rank")


Q_RANK = f"WITH {NEWS}, k AS (SELECT id, source_id, fetched_s // {DAY} AS day, fetched_s, CAST(row_number() OVER (PARTITION BY source_id, fetched_s // {DAY} ORDER BY fetched_s DESC, id DESC) AS INTEGER) AS rank FROM nw) SELECT id, source_id, day, rank FROM k WHERE rank > 1 AND fetched_s < {NOW_S - 90 * DAY}"


def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 newest reports of each type."""
    return rel.top_k(_reports(spark, sf_dir), ["event_type"], [F.desc("last_s"), F.desc("id")], 30).select("id", "event_type", "rank")


Q_KEEP = f"WITH {REP} SELECT id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY last_s DESC, id DESC) AS INTEGER) AS rank FROM rep QUALIFY rank <= 30"


def per_day_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 3 items of each day."""
    n = news(spark, sf_dir).withColumn("day", F.floor(F.col("fetched_s") / DAY))
    return rel.top_k(n, ["day"], [F.desc("fetched_s"), F.desc("id")], 3).select("id", "day", "rank")


Q_LASTK = f"WITH {NEWS} SELECT id, fetched_s // {DAY} AS day, CAST(row_number() OVER (PARTITION BY fetched_s // {DAY} ORDER BY fetched_s DESC, id DESC) AS INTEGER) AS rank FROM nw QUALIFY rank <= 3"


# ---- spatial joins


def _pts(spark: SparkSession, sf_dir: str, name: str, key: str, *more: str) -> DataFrame:
    return spatial.with_point(table(spark, sf_dir, name).select(F.col("id").alias(key), "geom", *more)).drop("geom").distinct()


_ELL = "sqrt(pow({m} * radians({b}.lat - {a}.lat), 2) + pow({n} * cos(radians(({a}.lat + {b}.lat) / 2)) * radians({b}.lon - {a}.lon), 2))".replace("{m}", "(6378137.0 * (1 - 0.0066943799901413165) / pow(sqrt(1 - 0.0066943799901413165 * pow(sin(radians(({a}.lat + {b}.lat) / 2)), 2)), 3))").replace("{n}", "(6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(({a}.lat + {b}.lat) / 2)), 2)))")


def distance_join_5km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and events at most 5 km apart on the ellipsoid."""
    pairs = spatial.distance_join(_pts(spark, sf_dir, "frontline_claims", "claim_id"), _pts(spark, sf_dir, "extracted_events", "event_id"), "claim_id", "event_id", 5000.0, spatial.ellipsoid_m)
    return pairs.select("claim_id", "event_id", F.round("dist_m", 2).alias("dist_m"))


Q_DIST = f"WITH {EV} SELECT a.id AS claim_id, b.id AS event_id, round({_ELL.format(a='a', b='b')}, 2) AS dist_m FROM frontline_claims a JOIN ev b ON abs(a.lat - b.lat) < 0.06 AND {_ELL.format(a='a', b='b')} <= 5000"


def nearest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the claim within 10 km that ranks first by status, then distance, then id."""
    claims = _pts(spark, sf_dir, "frontline_claims", "claim_id", "status").withColumn("rank", F.coalesce(F.array_position(F.array(F.lit("pending"), F.lit("confirmed"), F.lit("reverted")), F.col("status")), F.lit(9)).cast("int")).where("rank BETWEEN 1 AND 3")
    best = spatial.nearest_join(_pts(spark, sf_dir, "extracted_events", "event_id"), claims, "event_id", "claim_id", 10000.0, spatial.ellipsoid_m, "rank")
    return best.select("event_id", "claim_id", F.round("dist_m", 2).alias("dist_m"))


Q_NEAR = f"WITH {EV}, p AS (SELECT b.id AS event_id, a.id AS claim_id, {_ELL.format(a='b', b='a')} AS d, CASE a.status WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 ELSE 3 END AS r FROM frontline_claims a JOIN ev b ON a.status IN ('pending','confirmed','reverted') AND abs(a.lat - b.lat) < 0.11 AND {_ELL.format(a='b', b='a')} <= 10000) SELECT event_id, claim_id, round(d, 2) AS dist_m FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY r, d, claim_id) = 1"


def _near_in_time(spark: SparkSession, sf_dir: str, radius_m: float, slack_s: int) -> DataFrame:
    """``event_id, report_id, type, dist_m``: type and a bucket of time are part of the join's key, so that only pairs of one type and about one time are compared."""
    e = _pts(spark, sf_dir, "extracted_events", "event_id", "event_type", "occurred_at").withColumns({"at": sec("occurred_at"), "type": F.col("event_type")}).where("at IS NOT NULL AND type IS NOT NULL")
    r = spatial.with_point(_reports(spark, sf_dir).select(F.col("id").alias("report_id"), "geom", F.col("event_type").alias("type"), "first_s", "last_s")).where("type IS NOT NULL AND first_s <= last_s")
    bucket = max(slack_s, DAY)
    spans = r.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("first_s") - slack_s) / bucket), F.floor((F.col("last_s") + slack_s) / bucket))))
    pairs = spatial.distance_join(spans, e.withColumn("bucket", F.floor(F.col("at") / bucket)), "report_id", "event_id", radius_m, spatial.ellipsoid_m, ("type", "bucket"))
    out = pairs.join(e.select("event_id", "at"), "event_id").join(r.select("report_id", "first_s", "last_s"), "report_id")
    return out.where(F.col("at").between(F.col("first_s") - slack_s, F.col("last_s") + slack_s)).select("event_id", "report_id", "type", "dist_m")


def space_time_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and reports of one type within 30 km, the event at most 30 days outside the report's time span."""
    return _near_in_time(spark, sf_dir, 30000.0, 30 * DAY).select("event_id", "report_id", F.col("type").alias("event_type")).distinct()


Q_SPACE_TIME = f"WITH {EV}, {REP} SELECT e.id AS event_id, r.id AS report_id, e.event_type FROM ev e JOIN rep r ON e.event_type = r.event_type AND e.occurred_s BETWEEN r.first_s - {30 * DAY} AND r.last_s + {30 * DAY} AND {_ELL.format(a='r', b='e')} <= 30000"


def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each claim's creation the newest earlier claim version of its direction."""
    c = table(spark, sf_dir, "frontline_claims").select("id", "direction", sec("updated_at").alias("valid_s"), sec("created_at").alias("at_s"))
    out = rel.as_of(c.select("direction", "valid_s", F.col("id").alias("version")), c.select("direction", "at_s"), ["direction"], "valid_s", "at_s")
    return out.select("direction", "at_s", "version", "valid_s")


Q_ASOF = "WITH c AS (SELECT id, direction, CAST(floor(epoch(updated_at)) AS BIGINT) AS valid_s, CAST(floor(epoch(created_at)) AS BIGINT) AS at_s FROM frontline_claims), q AS (SELECT DISTINCT direction, at_s FROM c), v AS (SELECT direction, valid_s, max(id) AS version FROM c GROUP BY ALL) SELECT q.direction, q.at_s, v.version, v.valid_s FROM q ASOF LEFT JOIN v ON v.direction = q.direction AND v.valid_s <= q.at_s"


# ---- members, places, packs


def digest_items(spark: SparkSession, sf_dir: str, more_than: int = DIGEST_PLACES) -> DataFrame:
    """Items that name more than ``more_than`` places."""
    place = F.coalesce(F.col("gazetteer_id").cast("string"), F.lower("place_name_raw"), F.col("id").cast("string"))
    e = events(spark, sf_dir, "news_item_id gazetteer_id place_name_raw")
    return e.groupBy("news_item_id").agg(F.countDistinct(place).alias("places")).where(F.col("places") > more_than)


Q_DIGEST = f"WITH {EV} SELECT news_item_id, count(DISTINCT coalesce(CAST(gazetteer_id AS VARCHAR), lower(place_name_raw), CAST(id AS VARCHAR))) AS places FROM ev GROUP BY 1 HAVING places > {DIGEST_PLACES}"


def perspective_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By gazetteer entry: the distinct sides that report it, sources, best tier and whether any event is a debunk."""
    g = star(spark, sf_dir, "event_type gazetteer_id", "visible AND gazetteer_id IS NOT NULL").groupBy("gazetteer_id").agg(
        F.array_join(F.array_sort(F.collect_set("side")), "+").alias("sides"), F.countDistinct("source_id").alias("n_sources"), F.min("tier").alias("best_tier"), F.bool_or(F.col("event_type") == "debunk").alias("disputed"), F.array_join(F.array_sort(F.collect_set(F.col("tier").cast("string"))), ",").alias("tiers"))
    return g


Q_SETS = f"WITH {STAR} SELECT gazetteer_id, string_agg(DISTINCT side, '+' ORDER BY side) AS sides, count(DISTINCT source_id) AS n_sources, min(tier) AS best_tier, bool_or(event_type = 'debunk') AS disputed, string_agg(DISTINCT CAST(tier AS VARCHAR), ',' ORDER BY CAST(tier AS VARCHAR)) AS tiers FROM star WHERE gazetteer_id IS NOT NULL GROUP BY 1"


def modal_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place name most often typed for each gazetteer entry."""
    return rel.modal(events(spark, sf_dir, "gazetteer_id place_name_raw", "gazetteer_id IS NOT NULL AND place_name_raw IS NOT NULL"), ["gazetteer_id"], "place_name_raw")


Q_MODAL = f"WITH {EV}, c AS (SELECT gazetteer_id, place_name_raw, count(*) AS n FROM ev WHERE gazetteer_id IS NOT NULL AND place_name_raw IS NOT NULL GROUP BY ALL) SELECT gazetteer_id, place_name_raw, n FROM c QUALIFY row_number() OVER (PARTITION BY gazetteer_id ORDER BY n DESC, place_name_raw) = 1"


def member_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 12 events of each gazetteer entry, the sides in turn, best tier and newest first within a side."""
    s = star(spark, sf_dir, "gazetteer_id occurred_s", "visible AND gazetteer_id IS NOT NULL").drop("title", "lang", "source_name")
    return rel.round_robin(s, ["gazetteer_id"], "side", [F.asc("tier"), F.desc_nulls_last("occurred_s"), F.desc("id")], 12).select("gazetteer_id", "id", "side", "turn", "pick")


Q_ROBIN = f"WITH {STAR}, t AS (SELECT gazetteer_id, id, side, CAST(row_number() OVER (PARTITION BY gazetteer_id, side ORDER BY tier, occurred_s DESC NULLS LAST, id DESC) AS INTEGER) AS turn FROM star WHERE gazetteer_id IS NOT NULL) SELECT *, CAST(row_number() OVER (PARTITION BY gazetteer_id ORDER BY turn, side) AS INTEGER) AS pick FROM t QUALIFY pick <= 12"


def recent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose newest event within 5 km (or creation, if none) is at most a week before the given instant."""
    c = _pts(spark, sf_dir, "frontline_claims", "claim_id", "created_at").withColumn("created_s", sec("created_at"))
    e = _pts(spark, sf_dir, "extracted_events", "event_id", "occurred_at").withColumn("at", sec("occurred_at")).where(f"at <= {NOW_S}")
    #: Of the events at one place only the newest can decide, and places are what is compared.
    spots = e.groupBy("x", "y").agg(F.max("at").alias("at"))
    near = spatial.near_places(c.select("x", "y").distinct(), spots, 5000.0, spatial.ellipsoid_m).join(spots.withColumnsRenamed({"x": "x2", "y": "y2"}), ["x2", "y2"]).groupBy(F.col("x1").alias("x"), F.col("y1").alias("y")).agg(F.max("at").alias("newest_s"))
    return c.select("claim_id", "created_s", "x", "y").join(near, ["x", "y"], "left").withColumn("active_s", F.coalesce("newest_s", "created_s")).where(f"active_s >= {NOW_S - 7 * DAY}").select("claim_id", "active_s")


Q_RECENT = f"WITH {EV}, c AS (SELECT id, lon, lat, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s FROM frontline_claims), p AS (SELECT a.id AS claim_id, max(b.occurred_s) AS newest_s FROM c a JOIN ev b ON abs(a.lat - b.lat) < 0.06 AND {_ELL.format(a='a', b='b')} <= 5000 AND b.occurred_s <= {NOW_S} GROUP BY 1) SELECT id AS claim_id, coalesce(newest_s, created_s) AS active_s FROM c LEFT JOIN p ON p.claim_id = c.id WHERE coalesce(newest_s, created_s) >= {NOW_S - 7 * DAY}"


def token_prefix_pack(spark: SparkSession, sf_dir: str, budget: int = PACK_TOKENS) -> DataFrame:
    """Each source's newest items while their estimated tokens fit the budget of a day; a first item above it is granted the budget, at least 200."""
    n = news(spark, sf_dir).select("id", "source_id", "fetched_s", F.floor(F.col("fetched_s") / DAY).alias("day"), text.estimated_tokens(F.col("body")).alias("tokens"))
    return rel.prefix_pack(n, ["source_id", "day"], [F.desc("fetched_s"), F.desc("id")], F.col("tokens"), budget, 200).select("id", "source_id", "day", "used", "position", "granted")


Q_PACK = f"WITH {NEWS}, t AS (SELECT id, source_id, fetched_s // {DAY} AS day, fetched_s, CASE WHEN length(coalesce(body, '')) > 0 THEN length(body) // 2 + 1 ELSE 0 END AS tokens FROM nw) SELECT id, source_id, day, CAST(sum(tokens) OVER w AS BIGINT) AS used, CAST(row_number() OVER w AS INTEGER) AS position, CAST(CASE WHEN sum(tokens) OVER w > {PACK_TOKENS} THEN least(tokens, greatest({PACK_TOKENS}, 200)) ELSE tokens END AS BIGINT) AS granted FROM t WINDOW w AS (PARTITION BY source_id, day ORDER BY fetched_s DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY used <= {PACK_TOKENS} OR position = 1"


def report_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events of one type at one gazetteer entry: a gap of more than a day opens a new one."""
    e = events(spark, sf_dir, "gazetteer_id event_type occurred_s", "gazetteer_id IS NOT NULL AND occurred_at IS NOT NULL")
    s = rel.sessions(e, ["gazetteer_id", "event_type"], "occurred_s", DAY)
    return s.groupBy("gazetteer_id", "event_type", "session").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_s").alias("first_s"), F.max("occurred_s").alias("last_s"))


Q_SESSIONS = f"WITH {EV}, g AS (SELECT gazetteer_id, event_type, occurred_s, CASE WHEN occurred_s - lag(occurred_s) OVER w > {DAY} THEN 1 ELSE 0 END AS brk FROM ev WHERE gazetteer_id IS NOT NULL AND occurred_s IS NOT NULL WINDOW w AS (PARTITION BY gazetteer_id, event_type ORDER BY occurred_s)), s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY gazetteer_id, event_type ORDER BY occurred_s) + 1 AS BIGINT) AS session FROM g) SELECT gazetteer_id, event_type, session, count(*) AS n, min(occurred_s) AS first_s, max(occurred_s) AS last_s FROM s GROUP BY ALL"


def debunk_url_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debunking events with the items whose address (slashes at its end aside) they name."""
    e = table(spark, sf_dir, "extracted_events").where("llm_raw.debunk_target IS NOT NULL").select("id", "llm_raw.debunk_target").distinct().select(F.col("id").alias("event_id"), F.rtrim(F.col("debunk_target"), F.lit("/")).alias("u"))
    return e.join(news(spark, sf_dir).where("url IS NOT NULL").select(F.col("id").alias("item_id"), F.rtrim(F.col("url"), F.lit("/")).alias("u")), "u").select("event_id", "item_id")


Q_DEBUNK = f"WITH {EV} SELECT e.id AS event_id, n.id AS item_id FROM ev e JOIN news_items n ON rtrim(n.url, '/') = rtrim(e.llm_raw.debunk_target, '/')"


def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose title or body needs a translation into English."""
    return news(spark, sf_dir).select("id", text.needs_translation(F.concat_ws(" ", "title", "body"), F.col("lang")).alias("needed"))


Q_TRANSLATE = "SELECT id, CASE WHEN trim(concat_ws(' ', title, body)) = '' THEN FALSE WHEN regexp_matches(concat_ws(' ', title, body), '[Ѐ-ӿ]') THEN TRUE WHEN coalesce(lang, '') = '' THEN FALSE ELSE NOT contains(lower(lang), 'english') END AS needed FROM news_items"


def place_transliterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer names in Latin letters."""
    return table(spark, sf_dir, "gazetteer").select("id", text.transliterate(F.col("name_uk")).alias("latin_uk"), text.transliterate(F.col("name_ru")).alias("latin_ru"))


def _latin_sql(c: str) -> str:
    for k, v in text.TRANSLITERATION.items():
        for x in dict.fromkeys((k, k.upper())):
            c = f"replace({c}, '{x.replace(chr(39), chr(39) * 2)}', '{v}')"
    return c


Q_LATIN = f"SELECT id, {_latin_sql('name_uk')} AS latin_uk, {_latin_sql('name_ru')} AS latin_ru FROM gazetteer"


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline for each item from its body's first lines."""
    return news(spark, sf_dir).where("body IS NOT NULL").select("id", text.headline(F.col("body")).alias("headline"))


Q_HEADLINES = r"""WITH l AS (SELECT id, body, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}\x0b\x{0085}]+|[\s\p{Z}\x0b\x{0085}]+$', '', 'g')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ls FROM news_items WHERE body IS NOT NULL)
SELECT id, substr(CASE WHEN len(ls) = 0 THEN regexp_replace(regexp_replace(body, '[\s\p{Z}\x0b\x{0085}]+', ' ', 'g'), '^ | $', '', 'g') ELSE list_reduce(ls, lambda a, x: CASE WHEN length(a) >= 24 THEN a ELSE a || ' ' || x END) END, 1, 200) AS headline FROM l"""

#: Word stems and phrases of the relevance filter.
RELEVANCE = (
    r"удар|обстріл|обстрел|наступ|наступл|просунул|просуну|звільни|освободи|захопи|захвати",
    r"штурм|окуп|оккуп|бої|боях|бой |боев|зачист|прорв|прорыв|відступ|отступ|контратак|контрнаступ",
    r"атак|уразил|ураже|вразил|знищ|уничтож|ліквідов|ликвидиров|підрив|подрыв|вибух|взрыв",
    r"втрат|потер|загинул|погиб|поранен|ранен|полонен|пленн|збит|сбит|уламк|обломк",
    r"дрон|бпла|безпілот|беспилот|ракет|каб |кабів|шахед|shahed|himars|атакмс|atacms",
    r"іскандер|искандер|артилер|артиллер|міномет|миномет|фпв|fpv|планув|планир",
    r"\bfront ?line\b|\bfrontline\b|\badvance[ds]?\b|\bliberat|\bcaptur|\brecaptur|\boffensive\b",
    r"\bassault\b|\bshelling\b|\bshelled\b|\bmissile\b|\bdrone\b|\bstrike[sd]?\b|\bstruck\b",
    r"\bwithdrew\b|\bwithdraw|\bencircl|\bsalient\b|\bbridgehead\b|\bgrey zone\b|\bgray zone\b",
    r"\bgeolocat|\bconfirmed footage\b|\bdebunk|\bstaged\b|\bai[- ]generated\b|\bdeepfake\b",
    r"\bdestroyed\b|\bdamaged\b|\babandoned\b|\bloss(es)?\b|\bloses\b|\blost\b|\bcasualt",
    r"\battack(ed|s|ing)?\b|\bhit\b|\bexplosion\b|\bwounded\b|\bkilled\b|\btroops\b",
    r"\bartiller|\bmortar\b|\bUAV\b|\bglide bomb\b|\bair ?strike",
    r"область|обл\.|оbласт|oblast|раїон|район|селищ|село|місто|город|напрямку|направлени",
    r"\w+(?:ivka|івка|овка|ovka|ське|sk|ськ|цьк|град|горск|горськ)\b",
    r"\braion\b|\bhromada\b|\bгромад",
)


#: RE2's word classes are ASCII, so the patterns that lean on them for Cyrillic are spelt out.
_RE2 = "|".join(RELEVANCE).replace(r"\w+(?:", r"[\p{L}\p{N}_]+(?:").replace(r"горськ)\b", r"горськ)(?:[^\p{L}\p{N}_]|$)").replace(r"\bгромад", r"(?:^|[^\p{L}\p{N}_])громад")
Q_RELEVANT = f"SELECT id FROM news_items WHERE regexp_matches(concat_ws(' ', title, body), '(?i){_RE2}')"


def relevance_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose title or body matches the relevance filter, in any case and script."""
    return news(spark, sf_dir).where(F.concat_ws(" ", "title", "body").rlike("(?iU)" + "|".join(RELEVANCE))).select("id")


def coord_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates written in ``geo`` of the losses or in the descriptions of geolocated records."""
    w = table(spark, sf_dir, "warspotting_recent").select(F.col("id").cast("string").alias("key"), F.col("geo").alias("t")).distinct()
    g = table(spark, sf_dir, "geoconfirmed_head").select(F.col("Id").alias("key"), F.concat_ws(" ", "Description", F.concat_ws(", ", "Latitude", "Longitude")).alias("t")).distinct()
    return w.unionByName(g).select("key", F.explode(text.coordinates(F.coalesce("t", F.lit("")))).alias("c")).select("key", "c.lat", "c.lon")


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their last arrival, never heard first: ordering with nulls first."""
    last = news(spark, sf_dir).groupBy("source_id").agg(F.max("fetched_s").alias("last_s"))
    s = sources(spark, sf_dir).select("source_id", "tier").join(last, "source_id", "left").where(F.col("last_s").isNull() | (F.col("last_s") < F.lit(1747000000) - F.col("tier") * 3600))
    return s.orderBy(F.asc_nulls_first("last_s"), "source_id").select("source_id", "tier", "last_s")


Q_DUE = f"WITH {SRC}, {NEWS}, l AS (SELECT source_id, max(fetched_s) AS last_s FROM nw GROUP BY 1) SELECT source_id, tier, last_s FROM src LEFT JOIN l USING (source_id) WHERE last_s IS NULL OR last_s < 1747000000 - tier * 3600"


def location_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each item and place (name and rounded point)."""
    e = events(spark, sf_dir, "news_item_id place_name_raw lon lat").select("news_item_id", F.coalesce(F.lower(F.trim("place_name_raw")), F.lit("")).alias("name"), F.coalesce(F.rint(F.col("lat") * 1e5).cast("bigint"), F.lit(-1)).alias("y"), F.coalesce(F.rint(F.col("lon") * 1e5).cast("bigint"), F.lit(-1)).alias("x"), "id")
    return rel.first_per_key(e, ["news_item_id", "name", "y", "x"], ["id"]).select("news_item_id", "id")


Q_LOCATION = f"WITH {EV} SELECT news_item_id, min(id) AS id FROM ev GROUP BY news_item_id, coalesce(lower(trim(place_name_raw)), ''), coalesce(CAST(round_even(lat * 1e5, 0) AS BIGINT), -1), coalesce(CAST(round_even(lon * 1e5, 0) AS BIGINT), -1)"


def active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims open at an instant: created before it, resolved after it or never."""
    c = table(spark, sf_dir, "frontline_claims").select("id", "direction", sec("created_at").alias("a"), sec("resolved_at").alias("b"))
    return c.where((F.col("a").isNull() | (F.col("a") <= NOW_S)) & (F.col("b").isNull() | (F.col("b") >= NOW_S))).select("id", "direction")


Q_ACTIVE = f"SELECT id, direction FROM frontline_claims WHERE (created_at IS NULL OR floor(epoch(created_at)) <= {NOW_S}) AND (resolved_at IS NULL OR floor(epoch(resolved_at)) >= {NOW_S})"


def report_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of 2024 merged with those updated since autumn: new values win, the first place name stays."""
    r = _reports(spark, sf_dir).select("id", "status", "place_name", "member_count", "first_s", "last_s")
    cols = ["id", "status", "place_name", "member_count"]
    return rel.upsert(r.where(f"first_s < {NOW_S}").select(cols), r.where(f"last_s >= {NOW_S - 60 * DAY}").withColumns({"status": F.lit("merged"), "place_name": F.lit("new")}).select(cols), ["id"], ["place_name"])


Q_UPSERT = f"WITH {REP}, o AS (SELECT * FROM rep WHERE first_s < {NOW_S}), n AS (SELECT * FROM rep WHERE last_s >= {NOW_S - 60 * DAY}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE 'merged' END AS status, CASE WHEN o.id IS NULL THEN 'new' ELSE o.place_name END AS place_name, coalesce(n.member_count, o.member_count) AS member_count, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.id = n.id"

_ALL = (
    (events_points_window, Q_POINTS), (events_grid_clusters, Q_GRID), (events_blackout_mask, Q_MASK), (news_placement_split, Q_PLACED), (news_blackout_items, Q_BLACKOUT), (news_keyset_page, Q_PAGE), (news_ilike_search, Q_ILIKE),
    (news_relevance_gate, Q_GATE), (news_snippets, Q_SNIPPETS), (news_events_nested, Q_NESTED), (content_hash_dedupe, Q_DEDUPE), (story_versions, Q_STORY), (timeline_histogram, Q_HIST), (timeline_bounds, Q_BOUNDS), (source_rollup, Q_ROLLUP),
    (retention_rank, Q_RANK), (retention_keep_n, Q_KEEP), (per_day_last_k, Q_LASTK), (distance_join_5km, Q_DIST), (nearest_claim, Q_NEAR), (space_time_neighbours, Q_SPACE_TIME), (asof_snapshot, Q_ASOF), (digest_items, Q_DIGEST),
    (perspective_sets, Q_SETS), (modal_place, Q_MODAL), (member_round_robin, Q_ROBIN), (recent_claims, Q_RECENT), (token_prefix_pack, Q_PACK), (report_sessions, Q_SESSIONS), (debunk_url_targets, Q_DEBUNK), (needs_translation, Q_TRANSLATE),
    (place_transliterations, Q_LATIN), (headlines, Q_HEADLINES), (relevance_prefilter, Q_RELEVANT), (coord_scan, COORDINATES), (due_sources, Q_DUE), (location_dedupe, Q_LOCATION), (active_window, Q_ACTIVE), (report_upsert, Q_UPSERT),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: q for f, q in _ALL if q}
