"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A transliteration of Ukrainian and Russian letters.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie",
    "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "",
    "ю": "iu", "я": "ia", "ы": "y", "э": "e", "ё": "e", "ъ": "", "'": "", "’": "",
}
#: Entities in the order in which they are undone (the ampersand before the angle brackets).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def strip(c: Column) -> Column:
    """Without any Unicode white space at the ends (``trim`` knows only the ordinary space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one ordinary space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of title and body up to case and white space; null parts count as empty."""
    empty = F.lit("")
    return F.sha2(F.lower(squeeze(strip(F.concat(F.coalesce(title, empty), F.lit("\n"), strip(F.coalesce(body, empty)))))), 256)


def transliterate(c: Column) -> Column:
    """Latin spelling; letters of the table lower-cased, all others kept. One-to-one letters go through ``translate``."""
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    none = [k for k, v in TRANSLITERATION.items() if not v]
    several = {k: v for k, v in TRANSLITERATION.items() if len(v) > 1}
    letters = "".join(single) + "".join(k.upper() for k in single if k.upper() != k)
    to = "".join(single.values()) + "".join(v for k, v in single.items() if k.upper() != k)
    out = F.translate(c, letters + "".join(none) + "".join(k.upper() for k in none if k.upper() != k), to)
    return reduce(lambda x, kv: F.replace(F.replace(x, F.lit(kv[0]), F.lit(kv[1])), F.lit(kv[0].upper()), F.lit(kv[1])), several.items(), out)


#: Elements whose content is no text; elements after which a line ends.
SILENT, LINE_ENDS = ("script", "style"), ("br", "p")


def strip_html(c: Column) -> Column:
    """Text of a snippet of HTML: silent elements dropped with their content, line ends kept, no other tags, entities undone.

    The snippet is cut at its opening angle brackets into a text and tagged pieces; each piece gives what its tag stands
    for and the text after it. A bracket that no other closes is text. At most one empty line is kept in a row.
    """
    for name in SILENT:
        c = F.regexp_replace(c, rf"(?is)<{name}\b.*?</{name}>", " ")
    pieces = F.split(F.coalesce(c, F.lit("")), "<")
    tag_name = lambda x: F.lower(F.regexp_extract(x, r"^(/?[A-Za-z0-9]*)", 1))
    ends = [n if n == "br" else f"/{n}" for n in LINE_ENDS]
    after = lambda x: F.concat(F.when(tag_name(x).isin(ends), "\n").otherwise(""), F.regexp_replace(x, "^[^>]*>", ""))
    text = F.transform(pieces, lambda x, i: F.when(i == 0, x).when(F.instr(x, ">") <= 1, F.concat(F.lit("<"), x)).otherwise(after(x)))
    c = F.array_join(text, "")
    for written, meant in ENTITIES:
        c = F.replace(c, F.lit(written), F.lit(meant))
    return strip(F.regexp_replace(c, r"[ \t]*\n(?:\s*\n)+", "\n\n"))


def headline(body: Column, at_least: int = 24, at_most: int = 200) -> Column:
    """The first lines that hold a letter or digit, joined until long enough, then cut; the whole body on one line if none does."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: strip(x)), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    joined = F.aggregate(lines, F.lit(""), lambda acc, x: F.when(F.length(acc) >= at_least, acc).otherwise(strip(F.concat_ws(" ", F.nullif(acc, F.lit("")), x))))
    return F.substring(F.when(F.size(lines) > 0, joined).otherwise(strip(squeeze(body))), 1, at_most)


def truncated(c: Column, size: int = 4000) -> Column:
    """Cut at ``size`` characters with a blank and an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.rtrim(F.substring(c, 1, size)), F.lit(" …"))).otherwise(c)


def slug_of(url: Column) -> Column:
    """The channel's name in an address such as ``https://host/s/name`` or ``https://host/name/12``; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^(?:https?://)?[^/\s]+/(?:s/)?([A-Za-z0-9_]+)", 1), F.lit(""))


def post_number(external_id: Column) -> Column:
    """The number after the last slash, or null."""
    return F.substring_index(external_id, "/", -1).try_cast("bigint")


def snippet(c: Column, size: int = 240) -> Column:
    """White space squeezed, cut at ``size`` characters with an ellipsis."""
    c = strip(squeeze(F.coalesce(c, F.lit(""))))
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size), r"\s+$", ""), F.lit("…"))).otherwise(c)


def estimated_tokens(c: Column) -> Column:
    """Half the characters and one, 0 for empty or null."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n > 0, F.floor(n / 2) + 1).otherwise(0).cast("bigint")


def display(first: Column, second: Column) -> Column:
    """``first`` unless null or empty, else ``second``."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


#: A decimal pair and a pair in degrees, minutes and seconds.
DECIMAL_PAIR = r"(?<![\d.])(\d{1,2}\.\d{3,})\s*[,;/ ]\s*(\d{1,2}\.\d{3,})(?![\d.])"
DMS_PAIR = r"(?i)(\d{1,2})[°º]\s*(\d{1,2})['′]\s*(\d{1,2}(?:\.\d+)?)?[\"″]?\s*([NS])[,;\s]+(\d{1,3})[°º]\s*(\d{1,2})['′]\s*(\d{1,2}(?:\.\d+)?)?[\"″]?\s*([EW])"


def coordinates(c: Column) -> Column:
    """Array of the distinct ``(lat, lon)`` written in a text: degrees, minutes and seconds first, then decimal pairs."""

    def part(pair: Column, pattern: str, i: int) -> Column:
        return F.coalesce(F.regexp_extract(pair, pattern, i).try_cast("double"), F.lit(0.0))

    def angle(pair: Column, i: int, back: str) -> Column:
        v = part(pair, DMS_PAIR, i) + part(pair, DMS_PAIR, i + 1) / 60 + part(pair, DMS_PAIR, i + 2) / 3600
        return F.round(F.when(F.upper(F.regexp_extract(pair, DMS_PAIR, i + 3)) == back, -v).otherwise(v), 6)

    dms = F.transform(F.regexp_extract_all(c, F.lit(DMS_PAIR), F.lit(0)), lambda p: F.struct(angle(p, 1, "S").alias("lat"), angle(p, 5, "W").alias("lon")))
    dec = F.transform(F.regexp_extract_all(c, F.lit(DECIMAL_PAIR), F.lit(0)), lambda p: F.struct(part(p, DECIMAL_PAIR, 1).alias("lat"), part(p, DECIMAL_PAIR, 2).alias("lon")))
    return F.array_distinct(F.concat(dms, dec))


def needs_translation(text: Column, language: Column) -> Column:
    """Blank: no; any Cyrillic: yes; no language known: no; else unless the language is English."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, False).when(text.rlike("[Ѐ-ӿ]"), True).when(F.coalesce(language, F.lit("")) == "", False).otherwise(~F.lower(language).contains("english"))


def loose_json(c: Column) -> Column:
    """The JSON object in a text that may be fenced or wrapped in prose; null if there is none that parses."""
    bare = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)


def indexed_results(c: Column, value: str) -> Column:
    """Members of the array ``results`` of a JSON text by their integer ``idx``: map of ``idx`` to ``value`` as text.

    Members that are no objects or lack an integer ``idx`` are skipped; of two with one ``idx`` the last wins.
    """
    members = F.from_json(F.get_json_object(c, "$.results"), "array<string>")
    pairs = F.transform(F.coalesce(members, F.array()), lambda m: F.struct(F.get_json_object(m, "$.idx").try_cast("int").alias("k"), F.get_json_object(m, f"$.{value}").alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
