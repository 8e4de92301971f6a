"""Texts that look the same: against unicodedata, each kind of deviation, odd inputs."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralens.llm import visual as V


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id bigint, t string, canonical string")
    return {r["id"]: r["canonical"] for r in V.canonical_text(df, "t").collect()}


def flags(spark, texts):
    rows = V.deviations(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    found = {r["t"]: {k for k in V.FLAGS if r[k]} for r in rows}
    return {t: found.get(t, set()) for t in texts}


def test_each_deviation(spark):
    cases = {
        "Ｗater": {"form"}, "ofﬁce": {"form"}, "а́": {"accent"}, "Łódź": set(), unicodedata.normalize("NFD", "kühl"): {"accent"}, unicodedata.normalize("NFD", "їжак"): {"accent"},
        "Све​ча": {"invisible"}, "a﻿b": {"invisible"}, "so­ft": {"invisible"}, "a b": {"space"}, "a　b": {"space"}, "тoчoк": {"mixed"}, "Κhmel": {"mixed"},
        "FPV-дрон": set(), "“x” — ‘y’ don’t": set(), "Жув'ясів": set(), "Ångström": set(), "№ 14": set(), "": set(), "12° ± 1°": set(), "ВЕЛИКІ": set(),
    }
    assert flags(spark, cases) == cases


def test_all_of_unicode_counts(spark):
    """Invisible characters, spaces, marks and scripts outside the usual blocks."""
    cases = {
        "a\u061cb": {"invisible"}, "a\u1680b": {"space"}, "a\u205fb": {"space"}, "か\u3099": {"accent"}, "अa": {"mixed"}, "օne": {"mixed"}, "paypaӏ": {"mixed"}, "ՀԱՅ": set(), "हिन्दी": {"accent"}, "שלום": set(), "漢字": set(), "한국": set(), "ქართული": set(),
    }
    assert flags(spark, cases) == cases
    assert forms(spark, ["か\u3099", "օne", "paypaӏ", "θάλaσσα", "한국"]) == {0: "が", 1: "one", 2: "paypal", 3: "θάλασσα", 4: "한국"}


def test_words_wholly_in_look_alikes_have_one_key(spark):
    pairs = [("СОР", "COP"), ("раура", "paypa"), ("ӏ", "l"), ("ѕсоре", "scope"), ("ОСА", "OCA"), ("ΑΒΕ", "ABE"), ("Ꭺᏼ", "AᏴ"), ("СО​Р", "COP"), ("дім", "дiм")]
    df = V.canonical_text(spark.createDataFrame([(i, side, t) for i, p in enumerate(pairs) for side, t in enumerate(p)], "id int, side int, t string"), "t").withColumn("key", V.comparison_key(F.col("canonical")))
    keys = {(r["id"], r["side"]): r["key"] for r in df.collect()}
    assert [i for i, _ in enumerate(pairs) if keys[i, 0] != keys[i, 1]] == [6]  # small Cherokee letters have no look-alike
    assert keys[0, 0] == "COP" and V.comparison_key(F.lit(None)) is not None


def test_the_table_of_look_alikes():
    assert all(V._script(g[0]) == "L" and all(V._script(c) not in (None, "L") for c in g[1:]) for g in V.LOOKALIKES.split())
    letters = [c for g in V.LOOKALIKES.split() for c in g]
    assert len(letters) == len(set(letters))


def test_one_form(spark):
    texts = ["Свечашівка", "Све​чашівка", "Свeчaшівкa", unicodedata.normalize("NFD", "Свечашівка"), "Свечашівка"]
    assert set(forms(spark, texts).values()) == {"Свечашівка"}
    assert forms(spark, ["ｏｆﬁｃｅ no １", "don’t", None, ""]) == {0: "office no 1", 1: "don't", 2: None, 3: ""}


def test_repeats_long_texts_and_empty_tables(spark):
    long = "слово " * 2000 + "сло​во"
    got = forms(spark, [long, long, "aḅ́́"])
    assert got[0] == got[1] == long.replace("​", "")
    assert got[2] == unicodedata.normalize("NFC", "aḅ́́")
    assert V.canonical_text(spark.createDataFrame([], "t string"), "t").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="aeouäöé ńżіїй̧̣́̈", max_size=12), min_size=5, max_size=20))
def test_marks_equal_unicode_normal_form(spark, texts):
    """Without look-alikes and apostrophes the form is Unicode's canonical composition."""
    texts = [t for t in texts if not ({"і", "ї", "й"} & set(unicodedata.normalize("NFC", t)) and set("aeouäöéńż") & set(t))]
    got = forms(spark, texts)
    for i, t in enumerate(texts):
        assert unicodedata.normalize("NFC", got[i]) == unicodedata.normalize("NFC", t)
