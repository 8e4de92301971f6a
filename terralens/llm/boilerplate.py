"""Lines that one source repeats over its documents.

Documents are reduced to the hashes of their normalised lines before anything is shuffled. Copies (same
source and same normalised body) collapse into clusters first; each line is then counted over clusters,
publication days and rows, so that a republished article can be told from a legal notice. Both counts are
plain partial aggregations; the one row per (source, line) that passes the threshold is joined back.

Size. With ``min_share`` s a source of documents of m lines on average has at most m / s such lines, whatever its
number of documents; the set is counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.io import broadcast_if_small, checkpointed

MAX_BROADCAST_LINES = 500_000


def normalised_lines(body: Column) -> Column:
    """The lines of ``body`` up to case, kind and number of spaces, spaces at the ends, and digits; null for null."""
    text = F.regexp_replace(F.regexp_replace(F.lower(body), "[ \\t\\u00a0]+", " "), "\\d+", "0")
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))


def _hashed(docs: DataFrame, source: str, doc: str, body: str, day: str | None = None) -> DataFrame:
    lines = normalised_lines(F.col(body))
    return docs.select(
        F.col(source).alias("source"), F.col(doc).alias("doc"), (F.to_date(F.col(day)) if day else F.lit(None).cast("date")).alias("day"),
        F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x))).alias("lines"), F.hash(F.lower(body)).alias("check"),
    )


def line_counts(docs: DataFrame, source: str, doc: str, body: str, day: str, dates: DataFrame | None = None) -> DataFrame:
    """``source, line, rows, clusters, days, source_rows``: how often each non-blank line stands in a source.

    A line counts once per document however often it stands there; documents with a null body count for
    ``source_rows`` only. A null source is a source of its own. With ``dates``, a table of the columns ``doc`` and ``day``, the
    days come from there and meet the documents' hashes, not their bodies.
    """
    hashed = _hashed(docs, source, doc, body, day if dates is None else None)
    if dates is not None:
        hashed = hashed.drop("day").join(dates.select(F.col(doc).alias("doc"), F.to_date(F.col(day)).alias("day")), "doc", "left")
    hashed = hashed.select("source", "day", F.array_sort(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("lines"), F.hash("lines").alias("h1"), F.xxhash64("lines").alias("h2"))
    clusters = hashed.where(F.size("lines") > 0).groupBy("source", "h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("day"), F.first("lines").alias("lines"))
    per_day = clusters.select("source", "rows", "day", F.explode("lines").alias("line")).groupBy("source", "line", "day").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    lines = per_day.groupBy("source", "line").agg(F.sum("rows").alias("rows"), F.sum("clusters").alias("clusters"), F.count(F.lit(1)).alias("days"))
    totals = docs.groupBy(F.col(source).alias("source_t")).agg(F.count(F.lit(1)).alias("source_rows"))
    return lines.join(totals, F.col("source").eqNullSafe(F.col("source_t"))).drop("source_t")


def boilerplate_lines(docs: DataFrame, source: str, doc: str, body: str, day: str, min_rows: int = 4, min_share: float = 0.08, min_clusters: int = 2, min_days: int = 2, dates: DataFrame | None = None) -> DataFrame:
    """The lines of ``line_counts`` in at least ``min_rows`` rows, ``min_share`` of the source's rows, ``min_clusters`` different documents and ``min_days`` days."""
    c = line_counts(docs, source, doc, body, day, dates)
    return c.where((F.col("rows") >= min_rows) & (F.col("rows") + 1e-6 >= min_share * F.col("source_rows")) & (F.col("clusters") >= min_clusters) & (F.col("days") >= min_days))


def line_report(docs: DataFrame, source: str, doc: str, body: str, day: str, min_rows: int = 4, min_share: float = 0.08, min_clusters: int = 2, min_days: int = 2, dates: DataFrame | None = None) -> DataFrame:
    """Every line repeated in a source: ``source, line_text, rows, clusters, days, source_rows, boilerplate``.

    Lines in at least ``min_rows`` rows and ``min_share`` of the source's; ``boilerplate`` tells those of them that stand in
    different documents on different days from the lines of an article that is republished. ``line_text`` is the
    smallest of the ways the line is written.
    """
    found = checkpointed(boilerplate_lines(docs, source, doc, body, day, min_rows, min_share, 1, 1, dates))
    written = docs.select(F.col(source).alias("_s"), F.posexplode(F.arrays_zip(F.split(F.col(body), "\n", -1).alias("raw"), normalised_lines(F.col(body)).alias("norm"))).alias("_at", "_l")).where("_l.norm <> ''")
    written = written.select("_s", F.xxhash64("_l.norm").alias("_line"), F.trim("_l.raw").alias("line_text"))
    known = broadcast_if_small(found.select("source", "line"), MAX_BROADCAST_LINES)
    text = written.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_line")), "left_semi").groupBy("_s", "_line").agg(F.min("line_text").alias("line_text"))
    both = found.join(text, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_line")))
    return both.select("source", "line_text", "rows", "clusters", "days", "source_rows", ((F.col("clusters") >= min_clusters) & (F.col("days") >= min_days)).alias("boilerplate"))


def boilerplate_places(docs: DataFrame, source: str, doc: str, body: str, day: str, **limits) -> DataFrame:
    """``doc, line_no`` (from 1, empty lines counted) of every place where a boilerplate line stands."""
    found = broadcast_if_small(checkpointed(boilerplate_lines(docs, source, doc, body, day, **limits).select(F.col("source").alias("s"), "line")), MAX_BROADCAST_LINES)
    places = _hashed(docs, source, doc, body).select("source", "doc", F.posexplode("lines").alias("at", "line")).where(F.col("line").isNotNull())
    return places.join(found, places.source.eqNullSafe(found.s) & (places.line == found.line), "left_semi").select(F.col("doc").alias(doc), (F.col("at") + 1).cast("bigint").alias("line_no"))


def without_boilerplate(docs: DataFrame, source: str, doc: str, body: str, day: str, **limits) -> DataFrame:
    """``docs`` plus ``clean_body``, the body without its source's boilerplate lines, and ``lines_removed``.

    Null bodies stay null; a body of boilerplate alone becomes empty. Columns of these two names are replaced. Each body
    meets the list of its source's lines and is read once; bodies are not shuffled unless all sources' lists together are
    too long to broadcast.
    """
    found = checkpointed(boilerplate_lines(docs, source, doc, body, day, **limits).select("source", "line"))
    cuts = found.groupBy(F.col("source").alias("_terralens_source")).agg(F.collect_list("line").alias("_terralens_cut"))
    if found.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES:
        cuts = F.broadcast(cuts)
    cut = F.coalesce("_terralens_cut", F.array().cast("array<bigint>"))
    pairs = F.arrays_zip(F.split(F.col(body), "\n", -1).alias("raw"), normalised_lines(F.col(body)).alias("norm"))
    kept = F.filter(pairs, lambda x: (x["norm"] == "") | ~F.array_contains(cut, F.xxhash64(x["norm"])))
    joined = docs.join(cuts, F.col(source).eqNullSafe(F.col("_terralens_source")), "left")
    joined = joined.withColumn("_terralens_kept", F.when(F.size(cut) > 0, kept).otherwise(pairs))
    clean = F.array_join(F.transform("_terralens_kept", lambda x: x["raw"]), "\n")
    removed = F.coalesce(F.size(F.split(F.col(body), "\n", -1)) - F.size("_terralens_kept"), F.lit(0))
    return joined.withColumns({"clean_body": F.when(F.col(body).isNotNull(), clean), "lines_removed": F.when(F.col(body).isNotNull(), removed).otherwise(0).cast("int")}).drop("_terralens_cut", "_terralens_source", "_terralens_kept")
