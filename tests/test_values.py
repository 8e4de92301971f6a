"""Loose values, binary geometries, names with hints."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralens.functions import text, values, wkb
from terralens.operators import similarity as S


def column(spark, xs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_values(spark):
    assert column(spark, ["UA", " Russia ", "other", "France", "", None], values.country_code) == ["ua", "ru", "other", None, None, None]
    assert column(spark, ["0.5", "7", "-1", "x", "NaN", None], values.fraction) == [0.5, 1.0, 0.0, None, None, None]
    assert column(spark, ["a", "b", None], lambda c: values.kind_or(c, ("a",))) == ["a", "other", "other"]
    assert column(spark, [0, 4, 5, 19, 20, None], values.failure_status, "int") == ["ok", "ok", "degraded", "degraded", "dead", "ok"]
    assert column(spark, [10_000, 9_990, 9_960, 6_400, 2_800, -90_000, None], lambda c: values.relative_time(c, F.lit(10_000)), "bigint") == ["just now", "just now", "1 min ago", "1 h ago", "2 h ago", "1 d ago", ""]
    pairs = spark.createDataFrame([("1", "2"), ("1", None), ("x", "2")], "a string, b string").select(values.both_or_none(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in pairs] == [(1.0, 2.0), None, None]


def test_texts(spark):
    assert column(spark, ["https://x.example/s/name", "https://x.example/name/12", "x.example/", "", None], text.slug_of) == ["name", "name", None, None, None]
    assert column(spark, ["a/12", "12", "a/x", None], text.post_number) == [12, 12, None, None]
    assert column(spark, ["abc", "abcd ef", None], lambda c: text.truncated(c, 5)) == ["abc", "abcd …", None]
    assert column(spark, ["!!\n??", "--\nA headline that is long enough\nrest", "", None], text.headline) == ["!! ??", "A headline that is long enough", "", None]
    html = {"<p>a</p><p>b</p>": "a\nb", "a<br>b<BR/>c": "a\nb\nc", "<style>x</style>y<script src='z'>q<b></script>": "y", "1 < 2": "1 < 2", "a &amp;lt; b &nbsp;c": "a < b  c", "<b>x</b><i>y</i>": "xy", "": "", "a\n\n \n\nb": "a\n\nb"}
    assert column(spark, [*html, None], text.strip_html) == [*html.values(), ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), min_size=3, max_size=6), min_size=1, max_size=3), st.sampled_from([None, 4326]))
def test_binary_round_trips(rings, srid):
    head = f"SRID={srid};" if srid else ""
    body = "(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")"
    for t in (f"{head}POLYGON {body}", f"{head}MULTIPOLYGON ({body}, {body})", f"{head}POINT ({rings[0][0][0]!r} {rings[0][0][1]!r})"):
        assert wkb.decode(wkb.encode(t)) == t


def test_binary_columns(spark):
    texts = ["POINT (1.0 2.0)", "LINESTRING (0 0, 1 1)", "", None, "POINT EMPTY", "POLYGON ((a b))"]
    got = column(spark, texts, lambda c: wkb.from_wkb(wkb.as_wkb(c)))
    assert got == ["POINT (1.0 2.0)", None, None, None, None, None]
    assert wkb.encode("POINT (1 2)").hex() == "0101000000000000000000f03f0000000000000040"
    assert wkb.decode(bytes.fromhex("00000000013ff00000000000004000000000000000")) == "POINT (1.0 2.0)" and wkb.decode(b"\x01\x02") is None


GAZ = [(1, "novosilka", 100, "east", "novosilka"), (2, "novosilka", 90, "west", "novosilka"), (3, "kupiansk", 50_000, "east", "kupiansk kupyansk"), (4, "velyka rika", 10, "west", "velyka rika"), (5, "kupianske", 20, "west", "kupianske")]
REGIONS = {"east": ["east", "skhidna"], "west": ["west", "zakhidna"]}


def test_names_with_hints(spark):
    g = spark.createDataFrame(GAZ, "id int, name string, population int, region string, blob string")
    asked = [("Новосілка", "Східна область"), ("Новосілка", None), ("Новосілка", "west"), ("Kupiansk", None), ("Kupiansk", "zakhidna obl"), ("Velyka Rika", "east"), ("Velyka Riha", "east"), ("Moskva", None), ("ab", None), (None, "east"), ("село", None)]
    q = spark.createDataFrame(asked, "n string, h string")
    got = {(r["name"], r["hint"]): (r["entry"], r["ambiguous"], r["resolution"]) for r in S.match_names(q, "n", "h", g, "blob", "region", REGIONS, ("moskva",)).collect()}
    assert got == {
        ("Новосілка", "Східна область"): (1, False, "hinted"), ("Новосілка", None): (1, True, "countrywide"), ("Новосілка", "west"): (2, False, "hinted"), ("Kupiansk", None): (3, False, "countrywide"),
        ("Kupiansk", "zakhidna obl"): (5, False, "hinted"), ("Velyka Rika", "east"): (4, False, "fallback"),
    }
    assert S.match_names(q.limit(0), "n", "h", g, "blob", "region", REGIONS).count() == 0


@pytest.mark.parametrize("value, want", [("Східна", "east"), ("skhidna oblast", "east"), ("skhydna", "east"), ("zachidna", "west"), ("north", None), ("", None), (None, None)])
def test_regions(spark, value, want):
    assert column(spark, [value], lambda c: S.canonical_region(c, REGIONS)) == [want]
