"""Loose values made usable: coordinates, countries, kinds, numbers, ages, states of a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of countries and the words that stand for them; consecutive failures at which a source is degraded, dead.
COUNTRY_CODES = ("ua", "ru", "by", "md", "other")
COUNTRY_WORDS = {"ukraine": "ua", "russia": "ru", "belarus": "by", "moldova": "md"}
DEGRADED_AT, DEAD_AT = 5, 20


def both_or_none(lat: Column, lon: Column) -> Column:
    """Struct of two numbers, or null if either can't be read."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), F.struct(a.alias("lat"), b.alias("lon")))


def country_code(c: Column) -> Column:
    """A code of the list for a code or its word in any case; null for anything else, never a guess."""
    key = F.lower(F.trim(c))
    by_word = F.coalesce(*[F.when(key == word, F.lit(code)) for word, code in COUNTRY_WORDS.items()])
    return F.when(key.isin(*COUNTRY_CODES), key).otherwise(by_word)


def kind_or(c: Column, kinds: tuple[str, ...], default: str = "other") -> Column:
    """The value if it is one of ``kinds``, else ``default``."""
    return F.when(c.isin(*kinds), c).otherwise(default)


def fraction(c: Column) -> Column:
    """A number between 0 and 1; null for what can't be read, the nearer bound for what lies outside."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def failure_status(failures: Column) -> Column:
    """State of a source after so many failures in a row."""
    return F.when(failures >= DEAD_AT, "dead").when(failures >= DEGRADED_AT, "degraded").otherwise("ok")


def relative_time(at_s: Column, now_s: Column) -> Column:
    """How long ago, in the largest unit that gives a whole number; empty for null."""
    whole = lambda x: F.floor(x + F.lit(0.5))
    minutes = whole((now_s - at_s) / 60)
    hours = whole(minutes / 60)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(at_s.isNull(), "").when(minutes < 1, "just now").when(minutes < 60, said(minutes, "min")).when(hours < 24, said(hours, "h")).otherwise(said(whole(hours / 24), "d"))
