"""DuckDB's SQL for overlays, trigram similarity and scanned coordinates."""

from __future__ import annotations

from terralens.functions.text import TRANSLITERATION
from terralens.operators.similarity import APART, NOISE
from terralens.operators.spatial import WGS84_A, WGS84_E2

_E = WGS84_E2**0.5


def _from_equator(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({1 - WGS84_E2} * ({s} / (1 - {WGS84_E2} * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E})))"


def _area(nodes=((-(0.6**0.5), 5 / 18), (0.0, 8 / 18), (0.6**0.5, 5 / 18))) -> str:
    terms = [f"{w} * ({_from_equator(f'(h0 + (h1 - h0) * {(t + 1) / 2})')} - {_from_equator(f'(l0 + (l1 - l0) * {(t + 1) / 2})')})" for t, w in nodes]
    return f"({' + '.join(terms)}) * radians(x1 - x0) * {WGS84_A**2 / 2}"


#: Slabs between all corners, crossings and half degrees; in each the edges by height, and the layers of which a polygon lies between two of them.
OVERLAY_AREA = f"""
WITH z AS (SELECT DISTINCT CASE WHEN active THEN 'active' ELSE 'inactive' END AS layer, geom FROM blackout_zones WHERE geom IS NOT NULL),
zn AS (SELECT row_number() OVER () AS poly, layer, geom FROM z),
rings AS (SELECT poly, layer, unnest(regexp_extract_all(geom, '\\(([^()]+)\\)', 1)) AS ring FROM zn),
pos AS (SELECT poly, layer, string_split(ring, ',') AS p FROM rings), ends AS (SELECT poly, layer, trim(p[i]) AS a, trim(p[i % len(p) + 1]) AS b FROM pos, range(1, 2000) r(i) WHERE i <= len(p)),
raw AS (SELECT poly, layer, CAST(split_part(a, ' ', 1) AS DOUBLE) AS ax, CAST(split_part(a, ' ', 2) AS DOUBLE) AS ay, CAST(split_part(b, ' ', 1) AS DOUBLE) AS bx, CAST(split_part(b, ' ', 2) AS DOUBLE) AS b_y FROM ends),
e AS (SELECT row_number() OVER () AS n, poly, layer, least(ax, bx) AS ex1, CASE WHEN ax < bx THEN ay ELSE b_y END AS ey1, greatest(ax, bx) AS ex2, CASE WHEN ax < bx THEN b_y ELSE ay END AS ey2 FROM raw WHERE ax <> bx),
m AS (SELECT *, (ey2 - ey1) / (ex2 - ex1) AS k FROM e),
crossings AS (SELECT (b.ey1 - b.k * b.ex1 - a.ey1 + a.k * a.ex1) / (a.k - b.k) AS x, greatest(a.ex1, b.ex1) AS lo, least(a.ex2, b.ex2) AS hi FROM m a JOIN m b ON a.n < b.n AND a.ex1 < b.ex2 AND b.ex1 < a.ex2 AND a.k <> b.k),
cuts AS (SELECT ex1 AS x FROM m UNION SELECT ex2 FROM m UNION SELECT x FROM crossings WHERE x > lo AND x < hi UNION SELECT i * 0.5 FROM range(-360, 361) r(i)),
slabs AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1 FROM cuts),
s AS (SELECT x0, x1, poly, layer, ey1 + k * (x0 - ex1) AS y0, ey1 + k * (x1 - ex1) AS y1, row_number() OVER (PARTITION BY x0 ORDER BY ey1 + k * ((x0 + x1) / 2 - ex1), n) AS r FROM slabs JOIN m ON ex1 <= (x0 + x1) / 2 AND ex2 >= (x0 + x1) / 2 WHERE x1 > x0),
inside AS (SELECT g.x0, g.r, s.poly, any_value(s.layer) AS layer FROM s g JOIN s ON s.x0 = g.x0 AND s.r <= g.r GROUP BY g.x0, g.r, s.poly HAVING count(*) % 2 = 1),
gaps AS (SELECT x0, r, string_agg(DISTINCT layer, '+' ORDER BY layer) AS layers FROM inside GROUP BY 1, 2),
t AS (SELECT g.layers, a.x0, a.x1, a.y0 AS l0, a.y1 AS l1, b.y0 AS h0, b.y1 AS h1 FROM gaps g JOIN s a ON a.x0 = g.x0 AND a.r = g.r JOIN s b ON b.x0 = g.x0 AND b.r = g.r + 1)
SELECT layers, round(sum({_area()}) / 1e6, 3) AS km2 FROM t GROUP BY 1"""


def _latin(c: str) -> str:
    for k, v in TRANSLITERATION.items():
        c = f"replace({c}, '{k.replace(chr(39), chr(39) * 2)}', '{v}')"
    return c


def _words(c: str) -> str:
    noise = ", ".join(f"'{w}'" for w in NOISE)
    return f"array_to_string(list_filter(string_split(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({noise})), ' ')"


def _key(c: str) -> str:
    c = f"lower(coalesce({c}, ''))"
    for parted, letter in APART.items():
        c = f"replace({c}, '{parted}', '{letter}')"
    c = f"replace(replace(replace({c}, 'ʼ', ''), '’', ''), '''', '')"
    return _words(_latin(_words(c)))


def _grams(c: str) -> str:
    return f"flatten(list_transform(list_filter(string_split(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


#: All pairs that share a trigram and enough of them; of each the best run of the entry's trigrams.
_SIMILAR = f"""
names AS (SELECT DISTINCT place_name_raw AS p FROM extracted_events WHERE place_name_raw IS NOT NULL), keyed AS (SELECT DISTINCT {_key('p')} AS query FROM names),
q AS (SELECT query, list_distinct({_grams('query')}) AS g FROM keyed WHERE length(query) >= 3),
gz AS (SELECT id, population, {_key('name_uk')} AS a, {_key('name_ru')} AS b, {_key('name_en')} AS c FROM gazetteer),
gb AS (SELECT id, population, CASE WHEN b = a THEN CASE WHEN c = a THEN a ELSE a || ' ' || c END WHEN c = a OR c = b THEN a || ' ' || b ELSE a || ' ' || b || ' ' || c END AS blob FROM gz),
e AS (SELECT id AS entry, coalesce(population, 0) AS weight, {_grams('blob')} AS run FROM gb WHERE blob <> ''),
qg AS (SELECT query, unnest(g) AS gram FROM q), eg AS (SELECT entry, unnest(list_distinct(run)) AS gram FROM e),
met AS (SELECT query, entry, count(*) AS shared FROM qg JOIN eg USING (gram) GROUP BY 1, 2),
near AS (SELECT query, entry, g, run FROM met JOIN q USING (query) JOIN e USING (entry) WHERE shared >= greatest(1, ceil(0.6 * len(g) - 1e-9))),
spans AS (SELECT query, entry, g, run, i, unnest(range(i, len(run) + 1)) AS j FROM (SELECT *, unnest(range(1, len(run) + 1)) AS i FROM near)),
parts AS (SELECT query, entry, len(g) AS n, len(list_distinct(run[i:j])) AS d, len(list_intersect(g, run[i:j])) AS c FROM spans WHERE list_contains(g, run[i])),
scored AS (SELECT query, entry, max(c / (n + d - c)) AS score FROM parts GROUP BY 1, 2),
ranked AS (SELECT query, entry, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, weight DESC, entry) AS INTEGER) AS rank FROM scored JOIN e USING (entry) WHERE score >= 0.6 QUALIFY rank <= 8)"""
SIMILARITY = f"WITH {_SIMILAR} SELECT query, entry, score, rank FROM ranked"
SIMILAR_PLACE = f"WITH {_SIMILAR}, top AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM ranked) SELECT query, entry, score FROM top JOIN e USING (entry) WHERE best - score <= 0.05 + 1e-12 QUALIFY row_number() OVER (PARTITION BY query ORDER BY weight DESC, entry) = 1"

#: RE2 looks neither back nor ahead, so the character before and after a pair is part of the match.
_PAIR = r"(?:^|[^\d.])(\d{1,2}\.\d{3,})\s*[,;/ ]\s*(\d{1,2}\.\d{3,})(?:[^\d.]|$)"
COORDINATES = rf"""
WITH t AS (SELECT DISTINCT CAST(id AS VARCHAR) AS key, geo AS t FROM warspotting_recent UNION ALL SELECT DISTINCT Id, concat_ws(' ', Description, concat_ws(', ', CAST(Latitude AS VARCHAR), CAST(Longitude AS VARCHAR))) FROM geoconfirmed_head),
p AS (SELECT key, unnest(list_distinct(regexp_extract_all(t, '{_PAIR}'))) AS m FROM t WHERE t IS NOT NULL)
SELECT DISTINCT key, CAST(regexp_extract(m, '{_PAIR}', 1) AS DOUBLE) AS lat, CAST(regexp_extract(m, '{_PAIR}', 2) AS DOUBLE) AS lon FROM p"""
