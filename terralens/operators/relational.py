"""Operators over items, events and sources: windows, pages, semi-joins, top-k, nested aggregates, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of a grid cell by zoom.
GRID_BY_ZOOM = {3: 1.0, 4: 0.6, 5: 0.4, 6: 0.25, 7: 0.15, 8: 0.08, 9: 0.05, 10: 0.03}


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows for which every given condition holds; conditions that are None are left out."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def in_box(lon: Column, lat: Column, box: Sequence[float] | None) -> Column | None:
    """Inside ``(min_lon, min_lat, max_lon, max_lat)``, bounds included."""
    return None if box is None else lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def parse_box(text: str | None) -> tuple[float, ...] | None:
    """``minLon,minLat,maxLon,maxLat``; ValueError if it is not a box on the globe."""
    if not text:
        return None
    box = tuple(float(x) for x in text.split(","))
    if len(box) != 4 or not (-180 <= box[0] < box[2] <= 180 and -90 <= box[1] < box[3] <= 90):
        raise ValueError("a box is four numbers: west, south, east, north")
    return box


def keyset_page(df: DataFrame, when: Column, key: Column, size: int, after: tuple | None = None) -> DataFrame:
    """Newest ``size`` rows by ``(when, key)``, those before the pair ``after`` if given."""
    if after is not None:
        df = df.where(F.struct(when.alias("a"), key.alias("b")) < F.struct(F.lit(after[0]).alias("a"), F.lit(after[1]).alias("b")))
    return df.orderBy(when.desc(), key.desc()).limit(size)


def mean_degrees(c: str) -> Column:
    """Mean of degrees to 5 decimals over whole millionths, so that it does not depend on the order of the rows."""
    return F.floor((F.sum(F.rint(F.col(c) * 1e6).cast("bigint")) * 2 + F.count(c) * 10) / (F.count(c) * 20)) / 1e5


def grid_clusters(points: DataFrame, zoom: int, counts: dict[str, Column], limit: int | None = None) -> DataFrame:
    """Points with ``lon, lat`` by grid cell: ``n``, mean point, extent and one conditional count each; largest first."""
    g = GRID_BY_ZOOM[min(max(zoom, 3), 10)]
    cells = points.where(F.col("lon").isNotNull()).groupBy(F.rint(F.col("lon") / g).cast("bigint").alias("cx"), F.rint(F.col("lat") / g).cast("bigint").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), *[mean_degrees(c).alias(c) for c in ("lon", "lat")],
        *[F.round(f(c) + s * g / 4, 5).alias(k) for k, f, c, s in (("west", F.min, "lon", -1), ("south", F.min, "lat", -1), ("east", F.max, "lon", 1), ("north", F.max, "lat", 1))],
        *[F.count_if(c).alias(k) for k, c in counts.items()],
    )
    return cells if limit is None else cells.orderBy(F.desc("n"), "cx", "cy").limit(limit)


def damped_share(a: Column, b: Column) -> Column:
    """Share of ``a`` in ``a + b`` with one pseudo-count for each side, 4 decimals; a half when both are 0."""
    return F.round((a + 1) / (a + b + 2), 4)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def modal(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent ``value`` of each group (smallest of equals), nulls aside, with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def round_robin(df: DataFrame, by: Sequence[str], lane: str, order: Sequence[Column], k: int) -> DataFrame:
    """``k`` rows of each group, one of each lane in turn: the r-th of every lane before any (r+1)-th.

    A lane gives at most its first ``k`` rows, and of these each task keeps its own first ``k`` before the shuffle, so a
    group or lane of a third of all rows is never gathered.
    """
    df = df.withColumn("turn", F.row_number().over(Window.partitionBy(*by, lane).orderBy(*order))).where(F.col("turn") <= k)
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("turn", lane))).where(F.col("pick") <= k)


def as_of(versions: DataFrame, instants: DataFrame, by: Sequence[str], valid: str, at: str, chunk: int = 30 * 86400) -> DataFrame:
    """For each instant the newest version not after it: ``by, at`` and the version's columns (null if none).

    ``valid`` and ``at`` are integers. One union and no range join: versions and instants are put into chunks of time, the
    last version of each chunk is carried on to the next by a window over chunks, and within a chunk a window over its
    rows decides, so the history of one key is spread over its chunks. Of versions valid at one time the largest (by
    all columns) counts. Null keys meet null keys; versions and instants without a time don't count.
    """
    payload = [c for c in versions.columns if c not in by]
    v = versions.where(F.col(valid).isNotNull()).select(*by, F.col(valid).cast("bigint").alias("_t"), F.lit(0).alias("_q"), F.struct(*payload).alias("_v"))
    q = instants.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("bigint").alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v")).distinct()
    rows = v.unionByName(q).withColumn("_c", F.floor(F.col("_t") / chunk))
    newest = F.max(F.when(F.col("_q") == 0, F.struct("_t", "_v"))).alias("_n")
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*by, "_c").agg(newest).withColumn("_carried", F.last("_n", ignorenulls=True).over(before)).drop("_n")
    w = Window.partitionBy(*by, "_c").orderBy("_t", "_q", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_chunks(rows.withColumn("_last", F.last("_v", ignorenulls=True).over(w)), chunks, [*by, "_c"])
    rows = rows.withColumn("_last", F.coalesce("_last", "_carried._v"))
    return rows.where("_q = 1").select(*by, F.col("_t").alias(at), *[F.col(f"_last.{c}").alias(c) for c in payload])


def _with_chunks(rows: DataFrame, chunks: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``chunks``, one row per chunk; null keys meet null keys."""
    c = chunks.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[k for k in chunks.columns if k not in on])
    return rows.join(c, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on]).drop(*[f"_on_{k}" for k in on])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """``old`` with ``new`` merged by key: new values win except in ``keep_old``; adds ``action`` (kept, updated, inserted)."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*values).alias("_o"))
    n = new.select(*key, F.struct(*values).alias("_n"))
    both = o.join(n, list(key), "full")
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).when(F.col("_o").isNull() | F.lit(c not in keep_old), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    action = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "inserted").otherwise("updated")
    return both.select(*key, *[pick(c).alias(c) for c in values], action.alias("action"))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``, by a partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in {*key, *order}]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*key, "_b.*")


def prefix_pack(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column, budget: int, at_least: int = 0) -> DataFrame:
    """Rows of each group in order while their sizes fit ``budget``; the first row always does.

    Adds ``used``, ``position`` and ``granted``: the size a row may have, which is less than its own only for a first row
    above the budget (then the budget, but ``at_least`` that many).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumns({"used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "position": F.row_number().over(w)})
    granted = F.when(F.col("used") > budget, F.least(size, F.greatest(F.lit(budget), F.lit(at_least)))).otherwise(size)
    return df.withColumn("granted", granted).where((F.col("used") <= budget) | (F.col("position") == 1))


def sessions(df: DataFrame, by: Sequence[str], at: str, gap: int, chunk: int = 7 * 86400) -> DataFrame:
    """``df`` plus ``session``: a new one where more than ``gap`` lies between neighbours of a group in time.

    ``at`` is an integer; rows without it open no session and get none. Rows are put into chunks of time; what a row needs
    of earlier chunks (their last time, their sessions so far) comes from a window over chunks, so one group is
    spread over its chunks.
    """
    rows = df.withColumn("_c", F.floor(F.col(at) / chunk))
    groups, inside = Window.partitionBy(*by).orderBy("_c"), Window.partitionBy(*by, "_c").orderBy(at)
    ends = rows.where(F.col(at).isNotNull()).groupBy(*by, "_c").agg(F.max(at).alias("_end")).withColumn("_end", F.lag("_end").over(groups))
    rows = _with_chunks(rows.where(F.col(at).isNotNull()), ends, [*by, "_c"])
    rows = rows.withColumn("_new", F.coalesce((F.col(at) - F.coalesce(F.lag(at).over(inside), "_end") > gap).cast("int"), F.lit(0)))
    counts = rows.groupBy(*by, "_c").agg(F.sum("_new").alias("_n")).withColumn("_sofar", F.coalesce(F.sum("_n").over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = _with_chunks(rows, counts, [*by, "_c"])
    found = rows.withColumn("session", F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, 0)) + F.col("_sofar") + 1).select(*df.columns, "session")
    return found.unionByName(df.where(F.col(at).isNull()).withColumn("session", F.lit(None).cast("bigint")))


def percentile_disc(df: DataFrame, by: Sequence[str], value: str, q: float, bucket: int = 86400) -> DataFrame:
    """``by, value``: the smallest value of each group at or below which lie at least ``q`` of its values; exact.

    Values (integers, nulls aside) are counted, the counts summed by buckets of ``bucket``, and only the one bucket that
    holds the rank is walked, so no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(F.col("_v") / bucket))
    upto = Window.unboundedPreceding
    w = Window.partitionBy(*by)
    buckets = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_m")).withColumns({"_upto": F.sum("_m").over(w.orderBy("_b").rowsBetween(upto, 0)), "_rank": F.greatest(F.lit(1), F.ceil(F.sum("_m").over(w) * q - 1e-9))})
    buckets = buckets.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_m") < F.col("_rank"))).withColumn("_before", F.col("_upto") - F.col("_m")).drop("_m", "_upto")
    inside = _with_chunks(counts, buckets, [*by, "_b"])
    inside = inside.withColumn("_at", F.col("_before") + F.sum("_n").over(w.orderBy("_v").rowsBetween(upto, 0))).where(F.col("_at") >= F.col("_rank"))
    return inside.groupBy(*by).agg(F.min("_v").alias(value))


def merged_feed(newer: DataFrame, older: DataFrame, when: str, key: str, size: int) -> DataFrame:
    """One page of two feeds with the same columns, newest first: ``newer`` before ``older`` at the same time."""
    both = newer.withColumn("feed", F.lit(0)).unionByName(older.withColumn("feed", F.lit(1)))
    return both.orderBy(F.desc(when), "feed", F.desc(key)).limit(size)


def unseen(latest: DataFrame, shown: DataFrame, when: str, key: str) -> DataFrame:
    """Rows of ``latest`` to put before those ``shown``: unknown ones not older than the newest shown, or all if none is.

    The newest time is a scalar subquery, not a join.
    """
    top = shown.agg(F.max(when)).scalar()
    return latest.join(shown.select(key).distinct(), key, "left_anti").where(top.isNull() | (F.col(when) >= top))


def merged_maps(old: Column, new: Column) -> Column:
    """The entries of both maps, those of ``new`` before those of ``old``; null only if both are."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def upsert_maps(old: DataFrame, new: DataFrame, key: Sequence[str], maps: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """``upsert`` in which map columns are merged, entries of ``new`` before those of ``old``."""
    merged = upsert(old, new, key, keep_old).drop("action")
    o = old.select(*[F.col(k).alias(f"_on_{k}") for k in key], *[F.col(c).alias(f"_old_{c}") for c in maps])
    both = merged.join(o, [F.col(k) == F.col(f"_on_{k}") for k in key], "left")
    return both.withColumns({c: merged_maps(F.col(f"_old_{c}"), F.col(c)) for c in maps}).drop(*[f"_on_{k}" for k in key], *[f"_old_{c}" for c in maps])
