"""Languages: names of labels, spans of mixed text, held-out agreement, odd inputs."""

import numpy as np
import pytest

from terralens.io import table
from terralens.llm import langid as L

TEXTS = {
    "uk": ["Очевидці кажуть, що біля міста було кілька вибухів.", "Рятувальники працювали всю ніч, щоб загасити пожежу."],
    "ru": ["Очевидцы говорят, что возле города было несколько взрывов.", "Спасатели работали всю ночь, чтобы потушить пожар."],
    "en": ["Witnesses said that there were several explosions near the town.", "The crews worked all night to put out the fire."],
    "de": ["Die Feuerwehr löschte den Brand außerhalb der Stadt.", "Augenzeugen berichteten von lauten Geräuschen am Rand."],
    "pl": ["Świadkowie mówią o wybuchach w pobliżu miasta.", "Strażacy przez całą noc gasili pożar pod miastem."],
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i * 10 + k, t, " ".join(ts), lang) for lang, ts in TEXTS.items() for i, t in enumerate(ts * 3) for k in (hash(lang) % 7,)]
    return L.fit_word_model(spark.createDataFrame(rows, "id bigint, title string, body string, lang string"), "id", ("title", "body"), "lang")


def label(spark, model, rows):
    df = spark.createDataFrame(rows, "id bigint, title string, body string, lang string, langs string, parts int")
    return L.label_languages(df, ("id", "lang"), ("title", "body"), model)


@pytest.mark.parametrize("text, want", [("uk", "uk"), ("UK", "uk"), ("uk-UA", "uk"), ("de_DE", "de"), ("Polish", "pl"), ("ENG", "en"), (" rus ", "ru"), ("und", None), ("unknown", None), ("", None), (None, None), ("be", None), ("english text", None)])
def test_labels(spark, text, want):
    assert L.language_of_label(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(L.label_column(L.F.col("t"))).first()[0] == want


def test_segments_of_a_mixed_text(spark, model):
    rows = [(1, TEXTS["uk"][0], TEXTS["uk"][1] + " " + TEXTS["en"][0] + "\n" + TEXTS["en"][1] + "\n" + TEXTS["uk"][0], "uk", "x", 1)]
    got = [(r["part"], r["first"], r["last"], r["lang"]) for r in L.segments(label(spark, model, rows), ("id",)).orderBy("part", "first").collect()]
    assert got == [(0, 0, 0, "uk"), (1, 0, 0, "uk"), (1, 1, 2, "en"), (1, 3, 3, "uk")]
    assert all(0 < r["confidence"] <= 1 for r in L.segments(label(spark, model, rows), ("id",)).collect())


def test_quoted_words_and_look_alikes_do_not_count(spark, model):
    rows = [(1, "Очевидці кажуть, що на табличці був напис «The crews worked all night».", None, "uk", None, None), (2, TEXTS["ru"][0].replace("о", "o").replace("а", "a"), None, "ru", None, None), (3, "Ｔｈｅ ｃｒｅｗｓ ｗｏｒｋｅｄ ａｌｌ ｎｉｇｈｔ", "", "en", None, None)]
    assert L.mislabelled(label(spark, model, rows), "id", "lang").count() == 0


def test_odd_inputs(spark, model):
    rows = [(1, None, None, "uk", None, None), (2, "", "", None, None, None), (3, "12:30 — 5 !!", "\n\n", "en", None, None), (4, TEXTS["de"][0], TEXTS["de"][1] + " " + "Stadt " * 60_000, None, None, None), (4, TEXTS["de"][0], None, None, None, None)]
    labelled = label(spark, model, rows)
    assert {r["id"] for r in L.segments(labelled, ("id",)).collect()} == {4}
    assert {(r["id"], r["lang"]) for r in L.mislabelled(labelled, "id", "lang").collect()} == {(4, "de")}
    assert L.segments(label(spark, model, []), ("id",)).count() == 0


def test_model_of_an_empty_table(spark):
    empty = L.fit_word_model(spark.createDataFrame([], "id bigint, title string, body string, lang string"), "id", ("title", "body"), "lang")
    assert L._segment_batch([["Київ їде"]], empty)["langs"] == [["uk"]]


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    scores = rng.normal(size=(6, 3)) * 3
    for _ in range(20):
        ids, starts = rng.integers(0, 6, 6), rng.random(6) < 0.4
        lab = L.viterbi([ids], [starts], scores)[0]

        def total(path):
            return sum(scores[w, s] for w, s in zip(ids, path)) - sum((L.BETWEEN if starts[i] else L.IN_SENTENCE) * (path[i] != path[i - 1]) for i in range(1, 6))

        assert total(lab) == pytest.approx(max(total(p) for p in product(range(3), repeat=6)))


def test_held_out_agreement(spark, data):
    """Labels are noisy (about a tenth wrong); the languages found must agree with most that name one."""
    news = table(spark, data, "news_items")
    held = news.where("id % 2 = 0")
    m = L.fit_word_model(news.where("id % 2 = 1"), "id", ("title", "body"), "lang")
    rows = [(L.language_of_label(r["lang"]), set(r["langs"])) for r in L.label_languages(held, ("id", "lang"), ("title", "body"), m).collect()]
    named = [(a, b) for a, b in rows if a and b]
    assert sum(a in b for a, b in named) / len(named) > 0.85


def test_scripts_narrow_the_candidates():
    """A language that is not written in a word's script is out, whatever the counts say."""
    from collections import Counter

    m = L._fit([Counter({"тест": 5, "test": 90}), Counter({"тест": 3}), Counter({"test": 4, "тест": 90}), Counter(), Counter()])
    assert (m.scores[m.index["тест"]][2:] == L.MASKED).all() and (m.scores[m.index["test"]][:2] == L.MASKED).all()
    assert m.scores[m.row("тест")].argmax() == 0 and m.scores[m.row("test")].argmax() == 2
    assert (m.scores[m.row("невідоме")][2:] == L.MASKED).all() and (m.scores[m.row("straße")][:2] == L.MASKED).all() and (m.scores[m.row("漢字")] == 0).all()


def test_long_quotations_do_not_count(spark, model):
    quoted = " ".join([TEXTS["en"][0][:-1]] * 20)
    assert L.mislabelled(label(spark, model, [(1, f"Очевидці кажуть, що біля міста був напис «{quoted}» на стіні.", None, "uk", None, None)]), "id", "lang").count() == 0


def test_confidence_is_calibrated(spark, data):
    """Fragments of held-out sentences: how often the language is right lies near the confidence, and it doesn't saturate."""
    news = table(spark, data, "news_items")
    m = L.fit_word_model(news.where("id % 2 = 1"), "id", ("title", "body"), "lang")
    sents = [s for r in news.where("id % 2 = 0").select("title", "body").collect() for t in r for s in L.sentences(t)]
    total, lang = L.fragments(m, sents)
    p = L._softmax(total * m.temper)
    conf, right = p.max(axis=1), p.argmax(axis=1) == lang
    assert len(lang) > 300 and abs(conf.mean() - right.mean()) < 0.05
    for lo, hi in ((0.0, 0.9), (0.9, 1.01)):
        here = (conf >= lo) & (conf < hi)
        assert here.sum() < 30 or abs(conf[here].mean() - right[here].mean()) < 0.12


def test_recall_of_planted_segments(spark, data):
    """Sentences of one language put into texts of another come out as segments of their own."""
    news = table(spark, data, "news_items")
    m = L.fit_word_model(news, "id", ("title", "body"), "lang")
    by = {k: [" ".join(s).capitalize() + "." for r in news.where(L.label_column(L.F.col("lang")) == k).select("body").orderBy("id").limit(80).collect() for s in L.sentences(r[0]) if len(s) > 5] for k in L.LANGUAGES}
    by = {k: [s for s in v if L._segment_batch([[s]], m)["langs"][0] == [k]] for k, v in by.items()}
    planted = [(a, b, x, y) for a in by for b in by if a != b for x, y in list(zip(by[a][:12], by[b][12:24]))]
    found = L._segment_batch([[f"{x} {y} {x}"] for _, _, x, y in planted], m)["langs"]
    assert len(planted) > 60 and sum(got == [a, b, a] for (a, b, _, _), got in zip(planted, found)) >= 0.95 * len(planted)
