"""Mixed timestamp formats and zones brought to one UTC instant.

Every raw stamp is parsed by one regular expression into *all* its valid interpretations, kept as arrays of
seconds, formats and costs, the cheapest first: both orders of day and month, both occurrences of a repeated hour and
both offsets of a skipped one, the clock of the source and UTC, both centuries of a short year. What is declared
about a source (date order, home zone) and what is usual are costs. A Viterbi pass over each source's record order
then picks one interpretation per stamp, penalising format switches and backward time jumps.

A stamp's choice changes two transitions, so a reading that costs ``DOMINATED`` more than the cheapest is on no best
path: of the costs below, the clock and the century outweigh all neighbours, an order or an hour doesn't. A stamp with
one open reading is an *anchor*, and the best path decomposes exactly at anchors.

Scale. Records are put into chunks of the record order; a small per-chunk aggregate tells each record the segment
(anchor to anchor) it belongs to and the anchor that follows, by a scan over blocks of chunks and then over the
chunks of a block. So a source holding a third of all rows is still spread over as many tasks as it has segments, and
the result is that of one sequential pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.io import checkpointed, ship_package

#: First letters of the months' names in English, German, Polish, Russian and Ukrainian.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "jän": 1, "mär": 3, "mae": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12,
    "sty": 1, "lut": 2, "kwi": 4, "maj": 5, "cze": 6, "lip": 7, "sie": 8, "wrz": 9, "paź": 10, "paz": 10, "lis": 11, "gru": 12,
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
    "січ": 1, "лют": 2, "бер": 3, "кві": 4, "тра": 5, "чер": 6, "лип": 7, "сер": 8, "вер": 9, "жов": 10, "лис": 11, "гру": 12,
}
#: Minutes east of UTC of the usual European and US zone abbreviations.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "ist": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "мск": 180, "msd": 240, "trt": 180,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}

#: One pattern for every written form; groups are numbered in the comments.
PATTERN = (
    r"(?i)^\s*(?:[^\W\d_]{2,12}\.?,\s*)?(?:"
    r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"  # 1 year, 2 separator, 3 month, 4 day
    r"|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}|\d{2})"  # 5 and 7 day and month in either order, 6 separator, 8 year
    r"|(\d{4})(\d{2})(\d{2})(?=[T\s]|$)"  # 9 year, 10 month, 11 day
    r"|(\d{1,2})\.?[\s-]+([^\W\d_]+)\.?,?[\s-]+(\d{4})(?:\s*[гр]\.|\s*року|\s*года)?"  # 12 day, 13 month, 14 year
    r"|([^\W\d_]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"  # 15 month, 16 day, 17 year
    r"|(\d{10}|\d{13}|\d{16})"  # 18 seconds, milliseconds or microseconds since 1970
    r")(?:(?:T|[\s,]+(?:(?:godz\.?|um|at|о|об|в)\s+)?)(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(\d{2})(\d{2})?)"  # 19 hour, 20 and 22 minute, 21 and 23 second
    r"\s*([ap]\.?m\.?|uhr)?"  # 24 half of the day
    r"(?:\s*([^\W\d_]{1,5}(?=\s*(?:[\[(]|$))|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|\d{1,2}:?\d{2}))?"  # 25 zone
    r"(?:\s*\[([^\]]+)\]|\s*\([^)]*\))?"  # 26 region, or a remark
    r")?\s*$"
)
MARK = "\u0001"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
SWITCH, BACKWARD, SLACK_S = 1.0, 2.0, 6 * 3600
#: A reading that costs so much more than the cheapest is on no best path.
DOMINATED = 2 * (SWITCH + BACKWARD)
#: Costs of the order of day and month that is not declared, of month first where none is, of the other offset at a clock change, of another clock than the source's, of another century.
UNDECLARED, MONTH_FIRST, OTHER_OFFSET, OTHER_CLOCK, OTHER_CENTURY = 5.0, 0.1, 5.0, 7.0, 7.0
#: Chunks of a block.
BLOCK = 1024

CANDIDATES = "struct<secs:array<bigint>,fmts:array<string>,costs:array<double>>"
_COMPILED = re.compile(PATTERN)
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    """The named zone; UTC for none, null for an unknown one."""
    try:
        return ZoneInfo(name) if name else ZoneInfo("UTC")
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _offset_minutes(zone: str) -> int | None:
    """Minutes east of UTC of a written offset or abbreviation; an offset without sign is positive."""
    if zone[-1:].isalpha():
        return ZONES.get(zone.lower())
    zone = re.sub(r"(?i)^(?:utc|gmt)\s*|\s+", "", zone)
    digits = zone.lstrip("+-").replace(":", "")
    hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    total = hours * 60 + minutes
    return None if total > 18 * 60 or minutes > 59 else -total if zone[0] == "-" else total


def readings(raw: str | None, home_zone: str | None, slash_order: str | None, dash_order: str | None) -> list[tuple[int, str, float]]:
    """All valid interpretations ``(sec, fmt, cost)`` of one stamp, the cheapest first.

    Null, blank, relative and impossible stamps have none, nor has a date that is impossible in its declared order. In
    a zone, an hour that occurs twice is at first its first occurrence and a skipped hour reads with the offset in
    force before the change. Fractions of a second are cut off. An unknown home zone is UTC.
    """
    m = _COMPILED.match(raw) if raw else None
    if m is None:
        return []
    if m[18]:
        if m[19]:
            return []
        return [(int(m[18]) // {10: 1, 13: 1000, 16: 1000000}[len(m[18])], "epoch", 0.0)]
    if m[1]:
        dates = [(int(m[1]), int(m[3]), int(m[4]), "ymd", 0.0)]
    elif m[5]:
        short = len(m[8]) == 2
        order = {".": "dmy", "/": slash_order, "-": dash_order}[m[6]]
        known = order in ("dmy", "mdy")
        dates = []
        for name, month, day in (("dmy", m[7], m[5]), ("mdy", m[5], m[7])):
            cost = UNDECLARED * (order != name) if known else MONTH_FIRST * (name == "mdy")
            dates.append((int(m[8]) + 2000 * short, int(month), int(day), name, cost))
            if short:
                dates.append((int(m[8]) + 1900, int(month), int(day), name, cost + OTHER_CENTURY))
        if known and not _is_date(*next(x[:3] for x in dates if x[3] == order)):
            return []
    elif m[9]:
        dates = [(int(m[9]), int(m[10]), int(m[11]), "compact", 0.0)]
    else:
        year, name, day = (m[14], m[13], m[12]) if m[12] else (m[17], m[15], m[16])
        dates = [(int(year), MONTHS.get(name[:3].lower(), 0), int(day), "named", 0.0)]
    hour, minute, second = int(m[19] or 0), int(m[20] or m[22] or 0), int(m[21] or m[23] or 0)
    half = (m[24] or "")[:1].lower()
    if half in ("a", "p"):
        hour = hour % 12 + 12 * (half == "p") if 1 <= hour <= 12 else 99
    zones: list[tuple[ZoneInfo | None, float]] = [(None, 0.0)]
    offset = None
    if m[25]:
        offset = _offset_minutes(m[25])
        if offset is None:
            return []
    else:
        zone = _zone(m[26]) if m[26] else _zone(home_zone) or _zone(None)
        if zone is None:
            return []
        zones = [(zone, 0.0)] if m[26] or zone is _zone(None) else [(zone, 0.0), (_zone(None), OTHER_CLOCK)]
    found: dict[int, tuple[float, str]] = {}
    for y, mo, d, fmt, cost in dates:
        for zone, more in zones:
            for fold in (0, 1):
                try:
                    local = datetime(y, mo, d, hour, minute, second, fold=fold)
                    east = local.replace(tzinfo=zone).utcoffset() if offset is None else timedelta(minutes=offset)
                except (ValueError, OverflowError):
                    break
                sec = (local - _EPOCH - east) // timedelta(seconds=1)
                this = (cost + more + OTHER_OFFSET * fold, fmt)
                if sec not in found or this < found[sec]:
                    found[sec] = this
                if offset is not None:
                    break
    return sorted(((sec, fmt, cost) for sec, (cost, fmt) in found.items()), key=lambda x: (x[2], x[0]))


def _is_date(year: int, month: int, day: int) -> bool:
    try:
        datetime(year, month, day)
    except ValueError:
        return False
    return True


def _readings(raw: pd.Series, zone: pd.Series, slash: pd.Series, dash: pd.Series) -> pd.DataFrame:
    def text(s: pd.Series) -> list:
        return [x if isinstance(x, str) else None for x in s]

    found = [readings(*x) for x in zip(text(raw), text(zone), text(slash), text(dash))]
    return pd.DataFrame({"secs": [[x[0] for x in f] for f in found], "fmts": [[x[1] for x in f] for f in found], "costs": [[x[2] for x in f] for f in found]})


def interpretations(df: DataFrame) -> DataFrame:
    """``df`` plus ``secs, fmts, costs``: the arrays of all valid interpretations of ``raw``, see ``readings``.

    Reads ``home_zone``, ``slash_order`` and ``dash_order`` beside ``raw``.
    """
    ship_package(df.sparkSession)
    read = F.pandas_udf(_readings, CANDIDATES)
    return df.withColumn("_c", read("raw", "home_zone", "slash_order", "dash_order")).select("*", "_c.*").drop("_c")


def _viterbi(first: tuple | None, run: list[tuple], last: tuple | None) -> list[int]:
    """Indexes of the cheapest interpretation of each value of ``run`` between two anchors ``(sec, fmt)``."""

    def step(a: tuple, b: tuple) -> float:
        return SWITCH * (a[1] != b[1]) + BACKWARD * (b[0] < a[0] - SLACK_S)

    back: list[list[int]] = []
    states = [(0.0, first)] if first else []
    for secs, fmts, costs in run:
        new, came = [], []
        for sec, fmt, cost in zip(secs, fmts, costs):
            options = [c + step(s, (sec, fmt)) for c, s in states] or [0.0]
            k = int(np.argmin(options))
            new.append((options[k] + cost, (sec, fmt)))
            came.append(k)
        states = new
        back.append(came)
    ends = [c + (step(s, last) if last else 0.0) for c, s in states]
    k = int(np.argmin(ends))
    path = []
    for came in reversed(back):
        path.append(k)
        k = came[k]
    return path[::-1]


def _open(costs: np.ndarray) -> int:
    """How many readings, the cheapest first, may be on a best path."""
    return sum(c < costs[0] + DOMINATED for c in costs)


def _paths(rows: pd.DataFrame, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the reading chosen for each of the first ``stop`` rows, and how many are open."""
    secs, fmts, costs = rows["secs"].to_numpy(), rows["fmts"].to_numpy(), rows["costs"].to_numpy()
    open_ = np.array([_open(c) for c in costs])
    chosen = np.zeros(len(rows), dtype="int64")
    amb = np.flatnonzero(open_ > 1)
    amb = amb[amb < stop]
    if len(amb):
        group = (rows["source"].astype(str) + MARK + rows["seg"].astype(str)).to_numpy()
        nsec, nfmt = rows["next_sec"].to_numpy(), rows["next_fmt"].to_numpy()
        i = 0
        while i < len(amb):
            a = b = int(amb[i])
            while i + 1 < len(amb) and amb[i + 1] == b + 1 and group[b + 1] == group[a]:
                i, b = i + 1, b + 1
            i += 1
            before = (secs[a - 1][0], fmts[a - 1][0]) if a and group[a - 1] == group[a] else None
            if b + 1 < len(rows) and group[b + 1] == group[a]:
                after = (secs[b + 1][0], fmts[b + 1][0])
            else:
                after = None if pd.isna(nsec[b]) else (int(nsec[b]), nfmt[b])
            run = [(secs[x][: open_[x]], fmts[x][: open_[x]], costs[x][: open_[x]]) for x in range(a, b + 1)]
            chosen[a : b + 1] = _viterbi(before, run, after)
    return chosen, open_


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by source, segment and record order: one interpretation a row.

    Only the rows from the last anchor on are held back between batches, and joined once the next anchor has come.
    """
    held: list[pd.DataFrame] = []
    end = object()
    batches = iter(batches)
    while True:
        batch = next(batches, end)
        last = batch is end
        if not last:
            held.append(batch.assign(_old=False))
            if not any(_open(c) == 1 for c in batch["costs"]):
                continue
        if not held:
            return
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        held, stop = [], len(rows)
        if stop and not last:
            cut = max(np.flatnonzero([_open(c) == 1 for c in rows["costs"]]))
            held, stop = [rows.iloc[cut:].copy()], cut + 1
            held[0]["_old"] = [True] + [False] * (len(held[0]) - 1)
        chosen, open_ = _paths(rows, stop)
        out = rows.iloc[:stop]
        sec = np.array([s[k] for s, k in zip(out["secs"], chosen)], dtype="int64")
        yield pd.DataFrame({"tbl": out["tbl"], "row_key": out["row_key"], "raw": out["raw"], "sec": sec, "readings": out["secs"].map(len).astype("int32"), "open": open_[:stop].astype("int32"), "moved": chosen[:stop] > 0})[~out["_old"].to_numpy()]
        if last:
            return


def choose_readings(parsed: DataFrame) -> DataFrame:
    """One instant per stamp: ``tbl, row_key, raw, sec`` and how it came: ``readings`` it had, ``open`` ones, and ``moved``.

    ``parsed`` has ``tbl, row_key, raw, source, chunk, o1, o2, secs, fmts, costs``: records are ordered by ``(o1, o2)``
    within a source and ``chunk`` is any non-decreasing function of that order. Stamps without an
    interpretation drop out; ties in the order are broken by ``row_key``. ``moved`` tells that the path took another
    reading than the one that costs least by itself.
    """
    ship_package(parsed.sparkSession)
    rows = parsed.where(F.size("secs") > 0).select("tbl", "row_key", "raw", "source", "chunk", "o1", "o2", "secs", "fmts", "costs")
    single = (F.size("costs") == 1) | (F.get("costs", F.lit(1)) >= F.col("costs")[0] + DOMINATED)
    own = F.min(F.when(single, F.struct("o1", "o2", F.col("secs")[0].alias("sec"), F.col("fmts")[0].alias("fmt")))).alias("own")
    chunks = checkpointed(rows.groupBy("source", "chunk").agg(own)).withColumn("block", F.floor(F.col("chunk") / BLOCK))
    known = F.col("own").isNotNull()
    blocks = chunks.groupBy("source", "block").agg(F.max(F.when(known, F.col("chunk"))).alias("newest"), F.min(F.when(known, F.struct("chunk", "own"))).alias("oldest"))
    w = Window.partitionBy("source").orderBy("block")
    blocks = blocks.select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.max("newest").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("oldest.own", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    w = Window.partitionBy("source", "block").orderBy("chunk")
    chunks = (
        chunks.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        .withColumn("before", F.coalesce(F.max(F.when(known, F.col("chunk"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), "earlier"))
        .withColumn("after", F.coalesce(F.first("own", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "later"))
        .select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), "own", "before", "after")
    )
    inside = F.col("own").isNotNull() & (F.struct("o1", "o2") >= F.struct("own.o1", "own.o2"))
    following = F.when(inside, F.col("after")).otherwise(F.coalesce("own", "after"))
    rows = (
        rows.join(chunks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
        .withColumn("seg", F.when(inside, F.col("chunk")).otherwise(F.coalesce("before", F.lit(-(2**62)))))
        .withColumns({"next_sec": following["sec"], "next_fmt": following["fmt"]})
        .select("tbl", "row_key", "raw", "source", "seg", "o1", "o2", "secs", "fmts", "costs", "next_sec", "next_fmt")
    )
    rows = rows.repartition("source", "seg").sortWithinPartitions("source", "seg", "o1", "o2", "row_key")
    return rows.mapInPandas(_choose, "tbl string, row_key string, raw string, sec bigint, readings int, open int, moved boolean")


def as_utc(sec: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DDTHH:MM:SSZ``, in any session time zone."""
    text = F.timestamp_add("SECOND", sec, F.expr(EPOCH)).cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z"))


HOUR_US = 3_600_000_000


def news_stamps(news: DataFrame, clock: DataFrame) -> DataFrame:
    """``news_items.published_at`` with its record order (arrival) and what ``source_clock`` declares.

    A source that ``clock`` does not list has no declared order and reads in UTC; of several lines for one
    source the smallest counts.
    """
    clock = clock.groupBy("source_id").agg(F.min(F.struct("home_zone", "date_order")).alias("c")).select("source_id", "c.*")
    return news.select("id", "source_id", "published_at", "fetched_at").join(clock, "source_id", "left").select(
        F.lit("news_items").alias("tbl"), F.col("id").cast("string").alias("row_key"), F.col("published_at").alias("raw"),
        F.concat_ws(":", F.lit("news"), F.col("source_id").cast("string")).alias("source"),
        F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(0)).alias("o1"), F.coalesce("id", F.lit(-1)).cast("bigint").alias("o2"),
        F.expr(f"coalesce(unix_micros(cast(fetched_at as timestamp)), 0) div {6 * HOUR_US}").alias("chunk"),
        "home_zone", F.lower("date_order").alias("slash_order"), F.lower("date_order").alias("dash_order"),
    )


def geoconfirmed_stamps(geo: DataFrame) -> DataFrame:
    """``geoconfirmed_head.Date``: ``nn-nn-yyyy`` is day first, ``nn/nn/yyyy`` month first, records follow ``Id``."""
    rank = F.coalesce(F.conv(F.regexp_extract("Id", "^([0-9a-fA-F]{1,12})", 1), 16, 10).try_cast("bigint"), F.lit(0))
    return geo.select("Id", "Date").dropDuplicates().select(
        F.lit("geoconfirmed_head").alias("tbl"), F.col("Id").alias("row_key"), F.col("Date").alias("raw"), F.lit("geo").alias("source"),
        rank.alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.shiftrightunsigned(rank, 24).cast("bigint").alias("chunk"),
        F.lit(None).cast("string").alias("home_zone"), F.lit("mdy").alias("slash_order"), F.lit("dmy").alias("dash_order"),
    )


def warspotting_stamps(losses: DataFrame) -> DataFrame:
    """``warspotting_recent.date``: no zone means UTC, records follow ``id``."""
    return losses.select("id", "date").dropDuplicates().select(
        F.lit("warspotting_recent").alias("tbl"), F.col("id").cast("string").alias("row_key"), F.col("date").alias("raw"), F.lit("losses").alias("source"),
        F.coalesce("id", F.lit(-1)).cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.expr("coalesce(id, -1) div 256").cast("bigint").alias("chunk"),
        F.lit(None).cast("string").alias("home_zone"), F.lit(None).cast("string").alias("slash_order"), F.lit(None).cast("string").alias("dash_order"),
    )


def normalise_stamps(stamps: DataFrame) -> DataFrame:
    """``tbl, row_key, raw, sec, readings, open, moved`` for every stamp of ``stamps`` that names a full date, by the Viterbi pass."""
    return choose_readings(interpretations(stamps))
