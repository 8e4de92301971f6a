"""Wrong encodings: exact round trips, decoys, lost letters, odd inputs."""

import numpy as np
import pytest

from terralens.io import table
from terralens.llm import mojibake as J

CLEAN = {
    "uk": "Рятувальники працювали всю ніч, щоб загасити пожежу неподалік міста, про постраждалих не повідомляли.",
    "ru": "Волонтёры доставили генераторы и тонны воды, жителей просят сохранять спокойствие до вечера.",
    "pl": "Świadkowie mówią o wybuchach w pobliżu, żadna ze stron tego nie skomentowała.",
    "de": "Die Feuerwehr löschte den Brand außerhalb, Einzelheiten werden noch geprüft.",
}
WRONG = [("uk", "utf_8", "western"), ("ru", "utf_8", "cp1251"), ("ru", "koi8_r", "cp1251"), ("uk", "cp1251", "western"), ("pl", "utf_8", "western"), ("de", "utf_8", "western"), ("ru", "cp1251", "koi8_r")]


def garble(text, written, shown):
    chars = {b: c for c, b in J._bytes_of(shown).items() if shown != "western" or len(c) == 1}
    if shown == "western":
        chars = {b: bytes([b]).decode("latin_1") for b in range(128, 256)}
    return "".join(chars[b] if b > 127 else chr(b) for b in text.encode(written))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i in range(40) for t in [list(CLEAN.values())[i % 4]]]
    rows += [(100 + k, garble(CLEAN[lang], w, s)) for k, (lang, w, s) in enumerate(WRONG * 3)]
    return spark.createDataFrame(rows, "doc bigint, text string").selectExpr("*", "'c' AS unit", "'c' AS restored", "1 AS skeleton", "2 AS t")


@pytest.fixture(scope="module")
def model(corpus):
    return J.learn(corpus, "doc", "text", min_votes=1)


def test_round_trips(corpus, model):
    got = {r["doc"]: r["restored"] for r in J.restore(corpus, "doc", "text", model).collect()}
    assert got == {100 + k: CLEAN[lang] for k, (lang, _, _) in enumerate(WRONG * 3)}


def test_stretches_and_decoys(spark, model):
    good = ["Підпис: «Café Île», № 14.", "Замір: 12° ± 1°, ціна £40.", "В графе стояло лишь ???.", "Рядок │ 14 │ 22 │ заповнили.", "Question: what? Answer: 5", "https://x.example/?q=1", "ВСЕ ПРАВА ЗАЩИЩЕНЫ", "", None]
    bad = ["Служба каже: " + garble("працювали всю ніч", "utf_8", "western") + ", далі.", "l?schte den Brand", "?????? ?????????, ?? ?????", "Was �ber die Stadt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc bigint, text string")
    rows = {r["doc"]: r for r in J.restore(df, "doc", "text", model).collect()}
    assert set(rows) == set(range(len(good), len(good + bad)))
    assert rows[len(good)]["restored"] == "Служба каже: працювали всю ніч, далі." and not rows[len(good)]["lost"] and rows[len(good) + 1]["lost"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc bigint, text string")
    m = J.learn(empty, "doc", "text")
    assert m.learnt == () and J.restore(empty, "doc", "text", m).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, ""), (2, "a�b"), (2, "a�b"), (3, "é" * 100_000)], "doc bigint, text string")
    assert J.restore(nulls, "doc", "text", J.learn(nulls, "doc", "text")).count() == 2


def test_letter_pairs_come_from_all_documents(spark, monkeypatch):
    """Counts of every document, in the same proportion however many there are; pairs seldomer than one in ``PER_ROWS`` documents stay unknown."""
    texts = [f"слово {w}" for w in ("ґанок", "їжак", "щука", "żaba")] * 1500
    docs = spark.createDataFrame(list(enumerate([*texts, "хфжцз", "", None])), "doc bigint, text string").repartition(3)
    for held in (J.WORDS_HELD, 2):
        monkeypatch.setattr(J, "WORDS_HELD", held)
        counts = {r["unit"]: r["n"] for r in J._garbled_and_pairs(docs, "text").where("skeleton IS NULL").collect()}
        assert counts["^с"] == 6000 and counts["їж"] == counts["ża"] == 1500 and counts["хф"] == 1 and counts[""] == 6001
    pairs = J.learn(docs, "doc", "text").pairs
    assert pairs["їж"] == pytest.approx(np.log(1500 / 6001 * 4000 / (1500 / 6001 * 4000 + 60))) and "хф" not in pairs
    assert J.learn(docs.where("doc % 4 = 0 OR doc >= 6000"), "doc", "text").pairs["хф"] < 0


def test_real_texts_keep_clean_documents(spark, data):
    docs = table(spark, data, "documents")
    m = J.learn(docs, "doc_id", "text")
    n = docs.count()
    assert J.restore(docs, "doc_id", "text", m).count() < 0.2 * n


def test_a_full_bitmap_learns_the_same(corpus, model, monkeypatch):
    monkeypatch.setattr(J, "bitmap", lambda *_: np.full(2 << 18, 2**64 - 1, dtype=np.uint64))
    assert set(J.learn(corpus, "doc", "text", min_votes=1).learnt) == set(model.learnt)


def test_a_map_that_no_encodings_explain_is_learnt(spark):
    """Letters shifted along the alphabet with a few foreign ones between: found by alignment alone, and applied to texts without a twin."""
    letters = "абвгдеєжзиіїйклмнопрстуфхцчшщьюя"
    strange = dict(zip(letters, "ƀɓƃɖɗǝɛʒȥιɨɪʝƙłɱηøρʀʂʇυφχƈçʃʄɏɯʎ"))
    wrong = lambda t: "".join(strange.get(c, c) for c in t)
    clean = ["рятувальники працювали всю ніч, щоб загасити пожежу неподалік міста", "мешканці просять зберігати спокій до вечора, їжа є", "юнаки принесли щось цікаве, але жодного фото"]
    alone = "рятувальники просять зберігати пожежу"
    rows = [*clean, *map(wrong, clean), *(f"{k}: {wrong(t)}" for k, t in enumerate(clean)), *(f"{k}: {t}" for k, t in enumerate(clean)), wrong(alone)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc bigint, text string")
    m = J.learn(docs, "doc", "text")
    assert [how[0][0] for how in m.learnt] == ["map"]
    assert J.apply(wrong(alone), m.learnt[0]) == alone
    got = {r["doc"]: r["restored"] for r in J.restore(docs, "doc", "text", m).collect()}
    assert got[len(rows) - 1] == alone and got[3] == clean[0]


def test_maps_must_be_one_to_one():
    assert J._map_of([("ab", "xy"), ("ba", "yx")]) == {"a": "x", "b": "y"}
    assert J._map_of([("ab", "xx")]) is None and J._map_of([("aa", "xy")]) is None and J._map_of([("ab", "x")]) is None
    assert J._learnt_map([("ax", 3), ("ay", 2)]) == ()


@pytest.mark.parametrize("lang, written, shown", WRONG)
def test_restored_texts_of_the_corpus(spark, data, corpus, model, lang, written, shown):
    """Clean documents of the tables, garbled whole: at least nine of ten come back exactly."""
    texts = [r["text"] for r in table(spark, data, "documents").where(f"lang = '{lang}' AND text IS NOT NULL").select("text").orderBy("doc_id").collect() if not J.lost(r["text"]) and not J.ODD.search(r["text"]) and not r["text"].isascii()]
    pairs = []
    for t in texts:
        try:
            pairs.append((garble(t, written, shown), t))
        except (UnicodeEncodeError, KeyError):
            continue
    m = J.LetterModel(*J._letters(texts), model.learnt)
    exact = sum(m.restore(bad)[0] == t for bad, t in pairs)
    assert pairs and exact >= 0.9 * len(pairs), (exact, len(pairs))


def test_the_twin_need_not_be_the_smallest_of_its_skeleton(spark):
    twins, smaller = ["Школа стоить поруч", "Штаб найдет дорогу"], ["Аллея стояла возле", "Бабы купили молока"]
    rows = [*twins, *smaller, *(garble(t, "koi8_u", "cp1251") for t in twins)]
    assert (("cp1251", "koi8_u"),) in J.learn(spark.createDataFrame(list(enumerate(rows)), "doc bigint, text string"), "doc", "text").learnt


def test_long_tokens(spark, model):
    clean = "Рятувальники\u00a0працювали\u00a0" * 20
    whole = garble("Рятувальникипрацювали" * 10, "utf_8", "western")
    pieces = clean + garble("постраждалих", "utf_8", "western") + "\u00a0" + clean
    df = spark.createDataFrame(enumerate([whole, pieces, clean, "é" * 100_000]), "doc bigint, text string")
    assert {r["doc"]: r["restored"] for r in J.restore(df, "doc", "text", model).collect()} == {0: "Рятувальникипрацювали" * 10, 1: clean + "постраждалих\u00a0" + clean}
