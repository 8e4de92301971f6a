"""Readers of the formats that reports, losses, layers and place lists come in; each gives a DataFrame.

Text formats with a Spark reader use it (CSV, TSV, JSON). Markup is read as binary files, one row a file, and parsed
through Arrow; a file is the unit of parallelism. Rows that can't be used are dropped as stated, never errors; only a
file that isn't of the format at all raises.
"""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions import text
from terralens.io import ship_package

ITEM = "path string, external_id string, title string, body string, url string, published string"


def _first_date(*formats: str):
    def parse(c: Column) -> Column:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], c.try_cast("timestamp"))

    return parse


def geolocated_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("Id", "Date", "Latitude", "Longitude")) -> DataFrame:
    """Semicolon-separated records with a header, with or without a byte-order mark, quoted fields across lines allowed.

    Rows without usable coordinates are dropped; a blank or unreadable date is null. Raises ValueError if a
    required column is missing.
    """
    df = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"')
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    if missing := set(required) - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    date = _first_date("yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns({"lat": F.col("Latitude").try_cast("double"), "lon": F.col("Longitude").try_cast("double"), "published_at": date(F.nullif(F.col("Date"), F.lit("")))}).where("lat IS NOT NULL AND lon IS NOT NULL")


def geolocated_items(df: DataFrame) -> DataFrame:
    """Rows of ``geolocated_csv`` as items: ``external_id, title, body, url, lat, lon, published_at``; titles are cut at 200 characters."""
    text_of = lambda *c: F.concat_ws(" — ", *[F.nullif(F.col(x), F.lit("")) for x in c if x in df.columns])
    url = F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in ("Geolocation", "Source") if x in df.columns], F.lit(None).cast("string"))
    return df.select(F.col("Id").alias("external_id"), F.substring(F.coalesce(F.nullif(text_of("Name"), F.lit("")), F.col("Id")), 1, 200).alias("title"), text_of("Description", "Equipment", "Units").alias("body"), url.alias("url"), "lat", "lon", "published_at")


def complete_export(spark: SparkSession, path: str, at_least: int = 1000) -> str:
    """``path``, if the files there hold at least so many bytes; a smaller export is an error page and raises ValueError."""
    size = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0] or 0
    if size < at_least:
        raise ValueError(f"{path} holds {size} bytes only")
    return path


def recent(df: DataFrame, when: str, since: Column) -> DataFrame:
    """Rows since an instant; rows without a date stay."""
    return df.where(F.col(when).isNull() | (F.col(when) >= since))


LOSSES = "losses array<struct<id bigint, type string, model string, status string, lost_by string, date string, nearest_location string, geo string, unit string, tags string>>"


def losses_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per entry of ``losses`` with ``lat, lon, tag_list, title``; entries without ``lat,lon`` in ``geo`` are dropped.

    ``tags`` may be a list or a string with commas.
    """
    read = spark.read.schema(LOSSES).json(path, multiLine=True) if path else spark.createDataFrame([], LOSSES)
    df = read.select(F.explode("losses").alias("l")).select("l.*")
    geo = F.split(F.trim("geo"), r"\s*,\s*", 2)
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.split("tags", ","))
    tags = F.filter(F.transform(F.coalesce(tags, F.array()), lambda t: F.trim(t)), lambda t: t != "")
    what = F.concat_ws(" ", F.coalesce("model", "type", F.lit("equipment")), F.coalesce("status", F.lit("lost")), F.when(F.coalesce("nearest_location", F.lit("")) != "", F.concat(F.lit("near "), F.col("nearest_location"))))
    df = df.withColumns({"lat": geo[0].try_cast("double"), "lon": F.get(geo, F.lit(1)).try_cast("double"), "tag_list": tags, "title": F.substring(what, 1, 200), "published_at": F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd"))})
    return df.where("lat IS NOT NULL AND lon IS NOT NULL")


def losses_by_date(spark: SparkSession, pattern: str, last_day: str, days: int = 7) -> DataFrame:
    """``losses_json`` of the files of the ``days`` days up to ``last_day``; ``pattern`` holds ``{day}``, days without a readable file are skipped."""
    last = date.fromisoformat(last_day)
    wanted = [pattern.format(day=(last - timedelta(days=k)).isoformat()) for k in range(days)]
    return losses_json(spark, [p for p in wanted if _exists(spark, p)])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Tokens in the names of the features of a control layer.
OCCUPIED = ("status.occupied", "territories.crimea", "territories.ordlo")
GREY = ("status.unknown",)
FEATURES = "features array<struct<properties struct<name string>, geometry string>>"


def control_layers(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a GeoJSON collection: ``path, layer (occupied, grey, dropped), token, geom`` (well-known text, no height).

    The collection may be bare or under ``map``; features that are no polygons are left out.
    """
    df = spark.read.schema(f"{FEATURES}, map struct<{FEATURES}>").json(path, multiLine=True).withColumn("path", F.input_file_name())
    f = df.select("path", F.explode(F.coalesce("features", "map.features")).alias("f"))
    token = F.regexp_extract(F.replace(F.coalesce("f.properties.name", F.lit("")), F.lit(" "), F.lit(" ")), r"geoJSON\.((?:status|territories)\.[A-Za-z_]+)", 1)
    kind = F.get_json_object("f.geometry", "$.type")
    rings = F.when(kind == "Polygon", F.array(F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<array<array<array<double>>>>"))
    wkt = F.transform(rings, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda c: F.concat_ws(" ", c[0].cast("string"), c[1].cast("string"))), ", "), F.lit(")"))), ", "), F.lit(")")))
    out = f.where(kind.isin("Polygon", "MultiPolygon")).select("path", F.when(token == "", "untokenised").otherwise(token).alias("token"), F.concat(F.lit("MULTIPOLYGON ("), F.array_join(wkt, ", "), F.lit(")")).alias("geom"))
    return out.withColumn("layer", F.when(F.col("token").isin(*OCCUPIED), "occupied").when(F.col("token").isin(*GREY), "grey").otherwise("dropped"))


def dropped_tokens(layers: DataFrame) -> DataFrame:
    """How many features of ``control_layers`` were dropped, by token."""
    return layers.where("layer = 'dropped'").groupBy("token").agg(F.count(F.lit(1)).alias("dropped"))


def history_index(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots that an index lists, the oldest first: ``id, valid_s``; entries without an id or a plausible instant are left out.

    The index is a JSON list of objects with ``id`` (an instant or a name) and perhaps ``createdAt`` (milliseconds or an ISO time).
    """
    raw = spark.read.schema("id string, createdAt string").json(path, multiLine=True)
    written = F.coalesce(F.floor(F.col("createdAt").try_cast("double") / 1000).cast("string"), F.unix_seconds(F.col("createdAt").try_cast("timestamp")).cast("string"))
    return raw.select("id", F.coalesce(snapshot_instant(F.col("id")), snapshot_instant(written)).alias("valid_s")).where("id IS NOT NULL AND valid_s IS NOT NULL").orderBy("valid_s", "id")


EDITED = "features array<struct<properties struct<EditDate bigint>, geometry string>>"


def edited_layer(spark: SparkSession, path: str, seen_ms: int | None = None) -> tuple[DataFrame, int | None]:
    """Polygons ``path, geom`` of a layer whose features carry ``EditDate``, and the newest of these; no rows if that is ``seen_ms``."""
    newest = spark.read.schema(EDITED).json(path, multiLine=True).select(F.explode("features.properties.EditDate").alias("d")).agg(F.max("d")).first()[0]
    layer = control_layers(spark, path).select("path", "geom")
    return (layer.limit(0) if newest is not None and newest == seen_ms else layer), newest


def service_name(names: list[str], patterns: list[str]) -> str | None:
    """The first of ``names`` that the first matching pattern finds: patterns are tried in order of preference."""
    return next((n for p in patterns for n in names if re.search(p, n, re.IGNORECASE)), None)


def snapshot_instant(snapshot_id: Column) -> Column:
    """Seconds since 1970 that a snapshot id names, or null outside the plausible span."""
    n = snapshot_id.try_cast("bigint")
    return F.when((n > 1_600_000_000) & (n < 2_500_000_000), n)




def parse_feed(payload: bytes) -> list[dict]:
    """Entries of an RSS or Atom document: id (or link), title and body as HTML, link, date as written; [] if it is no XML."""
    try:
        root = ElementTree.fromstring(payload)
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    items = []
    for entry in root.iter():
        if local(entry) not in ("item", "entry"):
            continue
        parts: dict[str, list] = {}
        for child in entry:
            parts.setdefault(local(child), []).append(child)
        value = lambda *names: next((("".join(e.itertext())).strip() for n in names for e in parts.get(n, []) if "".join(e.itertext()).strip()), None)
        link = value("link") or next((e.get("href") for e in parts.get("link", []) if e.get("href")), None)
        body = " ".join("".join(e.itertext()) for n in ("encoded", "content") for e in parts.get(n, [])).strip()
        items.append({"external_id": value("id", "guid") or link, "title": value("title"), "body": body or value("summary", "description"), "url": link, "published": value("pubdate", "published", "updated", "created", "date")})
    return items


VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}


class _Page(html.parser.HTMLParser):
    """Blocks of a channel page: the post's name, its text by lines, its time."""

    def __init__(self, block: str, body: str):
        super().__init__(convert_charrefs=True)
        self.block, self.body, self.posts, self.depth, self.inside = block, body, [], 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.block in classes and a.get("data-post") is not None:
            self.posts.append({"external_id": a["data-post"] or None, "lines": [], "published": None})
        if tag in VOID:
            return
        self.depth += 1
        if self.posts and self.inside is None and self.body in classes:
            self.inside = self.depth
        if self.posts and tag == "time" and a.get("datetime") and not self.posts[-1]["published"]:
            self.posts[-1]["published"] = a["datetime"]

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if self.inside == self.depth:
            self.inside = None
        self.depth -= 1

    def handle_data(self, data):
        if self.inside is not None and data.strip():
            self.posts[-1]["lines"].append(data.strip())


def parse_channel_page(page: str, block: str = "message", body: str = "message_text") -> list[dict]:
    """Posts of a channel page that have a text: ``external_id, body, published``."""
    p = _Page(block, body)
    p.feed(page)
    return [{"external_id": x["external_id"], "title": None, "body": "\n".join(x["lines"]), "url": None, "published": x["published"]} for x in p.posts if x["lines"]]


def _parsed(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "external_id", "title", "body", "url", "published"]
        for pdf in batches:
            yield pd.DataFrame([{"path": p, **item} for p, content in zip(pdf["path"], pdf["content"]) for item in parse(content)], columns=names)

    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ITEM)


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS and Atom files: ``path, external_id, title, body, url, published`` with title and body as plain text."""
    df = _parsed(spark, path, parse_feed)
    return df.withColumns({"title": text.strip_html(F.col("title")), "body": text.strip_html(F.col("body"))})


def channel_pages(spark: SparkSession, path: str, block: str = "message", body: str = "message_text") -> DataFrame:
    """Posts of saved channel pages, titled by the first lines of their text; posts without a text are dropped."""
    df = _parsed(spark, path, lambda content: parse_channel_page(content.decode("utf-8", "replace"), block, body))
    return df.withColumn("title", text.headline(F.col("body")))


def watermark(posts: DataFrame, last_number: int | None) -> tuple[DataFrame, int | None, bool]:
    """``newer_posts``, the new highest number, and whether the page was empty, which is told before anything is filtered."""
    n, top = posts.agg(F.count(F.lit(1)), F.max(text.post_number(F.col("external_id")))).first()
    return newer_posts(posts, last_number), max((x for x in (top, last_number) if x is not None), default=None), n == 0


def newer_posts(posts: DataFrame, last_number: int | None) -> DataFrame:
    """Posts whose number (after the last slash of ``external_id``) is above the last one seen; all if none was."""
    number = text.post_number(F.col("external_id"))
    return posts if last_number is None else posts.where(F.coalesce(number, F.lit(0)) > last_number)


#: Codes of populated places, and the one of districts that are places of their own.
PLACE_CODES = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLA5", "PPLC", "PPLG", "PPLS", "PPLL", "PPLF", "PPLX")
PLACE_FIELDS = "geonameid name asciiname alternatenames lat lon fclass fcode country cc2 admin1 admin2 admin3 admin4 population elevation dem tz modified".split()


def places_zip(spark: SparkSession, path: str, codes: tuple[str, ...] = PLACE_CODES, city_regions: tuple[str, ...] = ()) -> DataFrame:
    """Populated places of a zipped tab-separated list; lines of another number of fields are dropped.

    Of the regions (``admin1``) that are cities, ``city_regions``, the districts (``ADM2``) are places too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".txt") and "readme" not in name.lower():
                            rows = [line.rstrip("\n").split("\t") for line in io.TextIOWrapper(z.open(name), "utf-8")]
                            yield pd.DataFrame([r for r in rows if len(r) == len(PLACE_FIELDS)], columns=PLACE_FIELDS)

    ship_package(spark)
    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{f} string" for f in PLACE_FIELDS))
    districts = (F.col("fcode") == "ADM2") & F.col("admin1").isin(*(city_regions or ("",)))
    return df.where(F.col("fcode").isin(*codes) | districts).withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "population": F.col("population").try_cast("bigint")})


def places_json(spark: SparkSession, path: str) -> DataFrame:
    """Places of a JSON list of map elements: local, Russian and English name, point (own or of the centre), population.

    Elements without a name or a point are dropped; an unreadable or zero population is null.
    """
    schema = "elements array<struct<lat double, lon double, center struct<lat double, lon double>, tags map<string, string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    tag = lambda k: F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit(""))
    out = e.select(
        F.coalesce(tag("name:uk"), tag("name")).alias("name_uk"), tag("name:ru").alias("name_ru"), tag("name:en").alias("name_en"), tag("addr:district").alias("raion"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), F.nullif(F.replace(tag("population"), F.lit(" "), F.lit("")).try_cast("int"), F.lit(0)).alias("population"), tag("place").alias("place"),
    )
    return out.where("name_uk IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def sniffed_csv(spark: SparkSession, path: str, sample: int = 4096) -> DataFrame:
    """A CSV file whose separator, comma or semicolon, is the more frequent in its first characters."""
    head = spark.read.text(path, wholetext=False).limit(50).collect()
    start = "\n".join(r[0] for r in head)[:sample]
    df = spark.read.csv(path, sep=";" if start.count(";") > start.count(",") else ",", header=True)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def column_of(df: DataFrame, pattern: str, share: float = 0.5) -> str | None:
    """The first column of which at least ``share`` of the filled values match a pattern, told by its values, not by its name."""
    tests = [F.try_divide(F.count_if(F.col(f"`{c}`").rlike(pattern)), F.count(F.nullif(F.col(f"`{c}`"), F.lit("")))).alias(str(i)) for i, c in enumerate(df.columns)]
    row = df.agg(*tests).first()
    return next((c for i, c in enumerate(df.columns) if (row[str(i)] or 0) >= share), None)


#: Fixed value: addresses that look like feeds.
FEEDISH = r"(?i)(rss|feed|\.xml|atom)"


def source_catalogue(df: DataFrame, perspectives: dict[str, str], intervals: dict[str, int], starters: tuple[str, ...] = (), default_interval: int = 900) -> DataFrame:
    """Sources of a catalogue: ``name, type, url, perspective, poll_interval_s, enabled, meta``, an address once (the first row by title).

    Only rows with a title, a known affiliation and free access. A channel's page is made of its name in ``url`` or
    ``handle_or_feed``; other rows need a feed's address in one of these, one that looks like a feed before others.
    """
    col = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    view = F.coalesce(*[F.when(col("affiliation_perspective") == k, F.lit(v)) for k, v in perspectives.items()], F.lit(None).cast("string"))
    slug = F.coalesce(*[F.nullif(F.regexp_extract(col(c), r"(?:^|//)t\.me/(?:s/)?([A-Za-z0-9_]+)", 1), F.lit("")) for c in ("url", "handle_or_feed")], F.when((col("primary_platform") == "Telegram") & col("handle_or_feed").startswith("@"), F.expr("substring(trim(handle_or_feed), 2)")))
    links = F.flatten(F.array(*[F.regexp_extract_all(col(c), F.lit(r"https?://[^\s,;|]+"), F.lit(0)) for c in ("handle_or_feed", "url")]))
    feed = F.when(col("machine_readable").contains("RSS"), F.coalesce(F.get(F.filter(links, lambda x: x.rlike(FEEDISH)), F.lit(0)), F.get(links, F.lit(0))))
    channel = (col("primary_platform") == "Telegram") & slug.isNotNull()
    interval = F.coalesce(*[F.when(col("update_frequency") == k, F.lit(v)) for k, v in intervals.items()], F.lit(default_interval))
    enabled = F.lit(False)
    for name in starters:
        enabled = enabled | F.lower(col("title")).contains(name.lower())
    rows = df.select(
        col("title").alias("name"), F.when(channel, "channel").otherwise("feed").alias("type"), F.when(channel, F.concat(F.lit("https://t.me/s/"), slug)).otherwise(feed).alias("url"), view.alias("perspective"), interval.cast("int").alias("poll_interval_s"), enabled.alias("enabled"),
        F.map_filter(F.create_map(F.lit("slug"), F.when(channel, slug), F.lit("category"), F.col("category"), F.lit("language"), F.col("language")), lambda _, v: v.isNotNull()).alias("meta"), F.lower(col("access")).contains("free").alias("_free"),
    )
    rows = rows.where("name <> '' AND perspective IS NOT NULL AND _free AND url IS NOT NULL").drop("_free")
    best = rows.groupBy("url").agg(F.min(F.struct("name", "type", "perspective", "poll_interval_s", "enabled", F.to_json("meta").alias("meta"))).alias("b"))
    return best.select("b.name", "b.type", "url", "b.perspective", "b.poll_interval_s", "b.enabled", F.from_json("b.meta", "map<string,string>").alias("meta"))


def backward_pages(read_page, newest: int, horizon_s: int, max_pages: int = 50) -> list[list[dict]]:
    """Pages read backwards from ``newest``: until one is empty, its oldest post (``number``, ``at_s``) is before the horizon, or there are enough.

    ``read_page(before)`` gives the posts before a number; pages depend on each other, so one channel is one task.
    """
    pages: list[list[dict]] = []
    before = newest
    while len(pages) < max_pages:
        page = read_page(before)
        if not page:
            break
        pages.append(page)
        if any(p["at_s"] is not None and p["at_s"] < horizon_s for p in page):
            break
        lowest = min(p["number"] for p in page)
        if lowest >= before:
            break
        before = lowest
    return pages


def feed_instant(published: str | None) -> int | None:
    """Seconds since 1970 of a feed's date in either usual form, or None."""
    if not published:
        return None
    try:
        return int(parsedate_to_datetime(published).timestamp())
    except (TypeError, ValueError):
        return None
