"""The instants of raw stamps in DuckDB's SQL, for stamps whose order and zone are declared or written."""

from __future__ import annotations

from terralens.operators.stamps import MONTHS, ZONES

_REST = r"(?:(?:T|[\s,]+(?:(?:godz\.?|um|at|о|об|в)\s+)?)(\d{1,2}):?(\d{2})?:?(\d{2})?(?:[.,]\d+)?\s*([AaPp]\.?[Mm]\.?|Uhr)?\s*(\p{L}{1,5}|(?:UTC|GMT)?\s*[+-]\d{1,2}(?::?\d{2})?|\d{1,2}:?\d{2})?(?:\s*\[([^\]]+)\]|\s*\([^)]*\))?)?$"
_FORMS = {
    "ymd": (r"^(?:\p{L}+\.?,\s*)?(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "y mo d"),
    "two": (r"^(?:\p{L}+\.?,\s*)?(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4}|\d{2})", "a sep b y"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})", "y mo d"),
    "day": (r"^(?:\p{L}+\.?,\s*)?(\d{1,2})\.?[\s-]+(\p{L}+)\.?,?[\s-]+(\d{4})(?:\s*[гр]\.|\s*року|\s*года)?", "d name y"),
    "month": (r"^(?:\p{L}+\.?,\s*)?(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", "name d y"),
}
_TIME = "h mi s half zone region"


def _map(values: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


def _parsed() -> str:
    """One SELECT per form, each of the stamps that have it."""
    parts = []
    for pattern, names in _FORMS.values():
        groups = f"{names} {_TIME}".split()
        pick = lambda c: f"nullif(g.{c}, '')" if c in groups else "NULL"  # noqa: B023, E731
        columns = ", ".join(f"{pick(c)} AS {c}" for c in "y mo d a sep b name".split() + _TIME.split())
        parts.append(f"SELECT tbl, row_key, raw, home, slash, dash, {columns} FROM (SELECT *, regexp_extract(t, '{pattern}{_REST}', {groups}) AS g FROM raw WHERE regexp_matches(t, '{pattern}{_REST}'))")
    return " UNION ALL ".join(parts)


_OFFSET = "(epoch(timezone(tz, to_timestamp({u}))) - ({u}))"
#: ``instants``: ``tbl, row_key, raw, sec`` of every stamp that names a full date.
STAMPS = rf"""
raw AS (
  SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM (
    SELECT 'news_items' AS tbl, CAST(id AS VARCHAR) AS row_key, published_at AS raw, home_zone AS home, lower(date_order) AS slash, lower(date_order) AS dash FROM news_items LEFT JOIN source_clock USING (source_id)
    UNION SELECT 'geoconfirmed_head', Id, Date, NULL, 'mdy', 'dmy' FROM geoconfirmed_head
    UNION SELECT 'warspotting_recent', CAST(id AS VARCHAR), date, NULL, 'dmy', 'dmy' FROM warspotting_recent) WHERE raw IS NOT NULL),
forms AS ({_parsed()}),
dated AS (
  SELECT *, CAST(y AS INTEGER) + CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END AS yy,
    CASE WHEN sep IS NOT NULL THEN CASE CASE sep WHEN '.' THEN 'dmy' WHEN '/' THEN slash ELSE dash END WHEN 'mdy' THEN CAST(a AS INTEGER) ELSE CAST(b AS INTEGER) END
         WHEN name IS NOT NULL THEN {_map(MONTHS)}[substr(lower(name), 1, 3)] ELSE CAST(mo AS INTEGER) END AS mm,
    CASE WHEN sep IS NOT NULL THEN CASE CASE sep WHEN '.' THEN 'dmy' WHEN '/' THEN slash ELSE dash END WHEN 'mdy' THEN CAST(b AS INTEGER) ELSE CAST(a AS INTEGER) END ELSE CAST(d AS INTEGER) END AS dd,
    CASE WHEN lower(half[1]) IN ('a', 'p') THEN CAST(h AS INTEGER) % 12 + CASE lower(half[1]) WHEN 'p' THEN 12 ELSE 0 END ELSE coalesce(CAST(h AS INTEGER), 0) END AS hh,
    coalesce(CAST(mi AS INTEGER), 0) AS mn, coalesce(CAST(s AS INTEGER), 0) AS ss,
    CASE WHEN regexp_matches(zone, '\p{{L}}$') THEN {_map(ZONES)}[lower(zone)] END AS named,
    regexp_extract(regexp_replace(zone, '(?i)^(utc|gmt)|\s', '', 'g'), '^([+-]?)(\d{{1,2}}):?(\d{{2}})?$', ['sign', 'oh', 'om']) AS o
  FROM forms),
locals AS (
  SELECT *, epoch(make_timestamp(yy, mm, dd, hh, mn, CAST(ss AS DOUBLE))) AS l, coalesce(region, home, 'UTC') AS tz,
    CASE WHEN zone IS NULL THEN NULL WHEN regexp_matches(zone, '\p{{L}}$') THEN named ELSE (CASE o.sign WHEN '-' THEN -1 ELSE 1 END) * (CAST(o.oh AS INTEGER) * 60 + coalesce(TRY_CAST(o.om AS INTEGER), 0)) END AS east
  FROM dated WHERE TRY_CAST(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE) IS NOT NULL AND hh < 24 AND mn < 60 AND ss < 60 AND (zone IS NULL OR NOT regexp_matches(zone, '\p{{L}}$') OR named IS NOT NULL)),
around AS (SELECT *, {_OFFSET.format(u='l - 86400')} AS o1, {_OFFSET.format(u='l + 86400')} AS o2 FROM locals),
instants AS (
  SELECT tbl, row_key, raw, CAST(CASE WHEN east IS NOT NULL THEN l - east * 60 WHEN o1 = o2 OR {_OFFSET.format(u='l - o1')} = o1 OR {_OFFSET.format(u='l - o2')} <> o2 THEN l - o1 ELSE l - o2 END AS BIGINT) AS sec FROM around
  UNION ALL SELECT tbl, row_key, raw, CAST(t AS BIGINT) // CASE length(t) WHEN 10 THEN 1 WHEN 13 THEN 1000 ELSE 1000000 END FROM raw WHERE regexp_full_match(t, '\d{{10}}|\d{{13}}|\d{{16}}'))"""

P2_SQL = rf"WITH {STAMPS} SELECT DISTINCT tbl, row_key, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM instants WHERE NOT regexp_full_match(raw, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ')"
_CELLS = f"""{STAMPS},
e AS (SELECT DISTINCT id, news_item_id, event_type, CAST(floor(epoch(occurred_at)) AS BIGINT) AS own_s FROM extracted_events),
r AS (SELECT e.id, event_type, coalesce(own_s, sec) AS event_s, epoch_us(n.fetched_at) / 1e6 AS arrival_s FROM e JOIN news_items n ON n.id = e.news_item_id LEFT JOIN instants i ON own_s IS NULL AND i.tbl = 'news_items' AND i.row_key = CAST(news_item_id AS VARCHAR)),
p AS (SELECT id, event_type, strftime(DATE '1970-01-01' + CAST(event_s // 86400 AS INTEGER), '%Y-%m-%d') AS event_day, CAST(greatest(0, ceil((arrival_s - (event_s // 86400 + 1) * 86400) / 3600)) AS BIGINT) AS lag_h FROM r WHERE event_s IS NOT NULL AND arrival_s IS NOT NULL)"""
P4_SQL = f"WITH {_CELLS} SELECT DISTINCT id, event_day, CASE WHEN lag_h <= 72 THEN 'late' ELSE 'cut' END AS outcome FROM p WHERE lag_h > 6"
P4_ALL_SQL = f"""WITH {_CELLS}, c AS (SELECT event_type, event_day, lag_h, CASE WHEN lag_h <= 6 THEN 'on_time' WHEN lag_h <= 72 THEN 'late' ELSE 'cut' END AS outcome, count(*) AS arrived FROM p GROUP BY ALL)
SELECT event_type, event_day, lag_h, outcome, arrived, row_number() OVER w AS revision, CAST(sum(CASE WHEN outcome <> 'cut' THEN arrived ELSE 0 END) OVER w AS BIGINT) AS total, CAST(sum(CASE WHEN outcome = 'cut' THEN arrived ELSE 0 END) OVER w AS BIGINT) AS beyond
FROM c WINDOW w AS (PARTITION BY event_type, event_day ORDER BY lag_h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
