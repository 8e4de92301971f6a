"""Text functions and relational operators on small inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from terralens.functions import text as X
from terralens.operators import relational as R


def ev(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


def test_text(spark):
    assert ev(spark, "Часів Яр", X.transliterate) == "chasiv iar" and ev(spark, "ЩУКА", X.transliterate) == "shchuka" and ev(spark, "Abc", X.transliterate) == "Abc"
    assert ev(spark, "<p>a&amp;lt;b</p><script>x</script>c<br/>d", X.strip_html) == "a<b\n c\nd"
    assert ev(spark, "--\nShort\nthen a longer line\nrest", X.headline) == "Short then a longer line"
    assert ev(spark, " a \n b　c", lambda c: X.squeeze(X.strip(c))) == "a b c"
    assert ev(spark, "x" * 300, X.snippet) == "x" * 240 + "…" and ev(spark, None, X.snippet) == ""
    assert [ev(spark, v, X.estimated_tokens) for v in (None, "", "abcd")] == [0, 0, 3]
    assert ev(spark, "T", lambda c: X.content_hash(c, F.lit(" B  b "))) == hashlib.sha256(b"t b b").hexdigest()
    assert [ev(spark, v, lambda c: X.needs_translation(c, F.lit("English"))) for v in ("", "привіт", "hello")] == [False, True, False]


def test_coordinates(spark):
    got = ev(spark, "at 48°30'15\" N, 37°45'00\" E and 48.12345, 37.54321; v1.2 9.1", X.coordinates)
    assert [(r["lat"], r["lon"]) for r in got] == [(pytest.approx(48.504167, abs=1e-6), 37.75), (48.12345, 37.54321)]


def test_json(spark):
    assert ev(spark, '```json\n{"a": 1}\n```', X.loose_json) == '{"a": 1}' and ev(spark, 'Sure: {"a": 2} ok', X.loose_json) == '{"a": 2}' and ev(spark, "none", X.loose_json) is None
    got = ev(spark, '{"results": [{"idx": 1, "t": "a"}, ["x"], null, 42, {"idx": "2", "t": "b"}, {"idx": 1, "t": "c"}, {"t": "z"}]}', lambda c: X.indexed_results(c, "t"))
    assert got == {1: "c", 2: "b"}


def test_as_of_and_upsert(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 2, "w")], "k string, t int, p string")
    q = spark.createDataFrame([("a", 0), ("a", 1), ("a", 9), ("c", 3), ("a", 9)], "k string, at int")
    assert {(r["k"], r["at"], r["p"]) for r in R.as_of(v, q, ["k"], "t", "at").collect()} == {("a", 0, None), ("a", 1, "x"), ("a", 9, "z"), ("c", 3, None)}
    old, new = spark.createDataFrame([(1, "a", "o"), (2, "b", "o")], "k int, v string, s string"), spark.createDataFrame([(2, "c", None), (3, "d", "n")], "k int, v string, s string")
    assert {(r["k"], r["v"], r["s"], r["action"]) for r in R.upsert(old, new, ["k"], ["s"]).collect()} == {(1, "a", "o", "kept"), (2, "c", "o", "updated"), (3, "d", "n", "inserted")}


def test_round_robin_pack_sessions(spark):
    df = spark.createDataFrame([(1, lane, i) for lane, n in (("a", 5), ("b", 2), ("c", 1)) for i in range(n)], "g int, lane string, i int")
    assert [(r["lane"], r["i"]) for r in R.round_robin(df, ["g"], "lane", [F.asc("i")], 5).orderBy("pick").collect()] == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("b", 1)]
    assert [r["i"] for r in R.prefix_pack(df.where("lane = 'a'"), ["g"], [F.asc("i")], F.lit(4), 9).orderBy("i").collect()] == [0, 1]
    assert R.prefix_pack(df.where("lane = 'a'"), ["g"], [F.asc("i")], F.lit(40), 9).count() == 1
    t = spark.createDataFrame([(1, x) for x in (0, 5, 20, 24, 60)], "g int, t int")
    assert [r["session"] for r in R.sessions(t, ["g"], "t", 10).orderBy("t").collect()] == [1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        R.parse_box("1,2,0,3")
    assert R.parse_box("1,2,3,4") == (1, 2, 3, 4) and R.parse_box(None) is None
