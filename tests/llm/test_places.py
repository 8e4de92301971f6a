"""Place names: forms and errors of writing, oblasts, accuracy on rows whose entry is known."""

import pytest

from terralens.io import table
from terralens.llm import places as P

ENTRIES = [(1, "Свечашівка", "Свечашовка", "Svechashivka", "lozhyn"), (2, "Борушезопіль", "Борушезополь", None, "svitan"), (3, "Борушезопіль", "Борушезополь", None, "olshan"), (4, "Верхнє Хокомине", "Верхнее Хокоминое", "Verkhnie Khokomyne", "medobir"), (5, "Зулкижеків", None, None, "rudnyts"), (6, "Скрув'янове", "Скрувьяновое", "Skruvianove", None)]


@pytest.fixture(scope="module")
def g():
    return P.Gazetteer(ENTRIES)


@pytest.mark.parametrize(
    "value, hint, want",
    [
        ("Свечашівка", None, 1), ("с. Свечашівка", None, 1), ("у Свечашівці", None, 1), ("Svechashovka", None, 1), ("village of Svechashivka community", None, 1), ("Свечашвка", None, 1), ("Свечшаівка", None, 1), ("Svechasihvka", None, 1),
        ("«СВЕЧАШІВКА»", None, 1), ("#Свечашівка", None, 1), ("Све​чашівкa", None, 1), ("Свечашівка, Ложинська область", None, 1),
        ("Борушезопіль", None, 0), ("Борушезопіль", "Світанська обл.", 2), ("Борушезополі (Ольшанская обл.)", None, 3), ("Ольшанська область, Борушезополь", "svitan", 3), ("Borushezopil / Svitan", None, 2), ("Борушезопіль", "Лемурська", 0),
        ("Verkhnee Khokominoe", None, 4), ("Верхньому Хокомині", None, 0), ("Верхньому Хокоминому", None, 4), ("Зулкижекові", None, 5), ("Скрувянове", None, 6), ("Скрув’янове", None, 6),
        ("Ложинська область", None, 0), ("північний напрямок", None, 0), ("вул. Свечашівка, 7", None, 0), ("траса Свечашівка", None, 0), ("Кикичосельгора", None, 0), ("", None, 0), ("   ", None, 0), (None, None, 0), ("Свечашівка, Зулкижеків", None, 0), ("я" * 20_000, None, 0), ("a b " * 5000, None, 0),
    ],
)
def test_values(g, value, hint, want):
    assert g.match(value, hint) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("Хокомине Верхнє", 4), ("верхна хокомина", 4), ("Khokomyne Verkhnie", 4), ("Хокоминому Верхньому", 4), ("Хокомнне Верхне", 4), ("Sviechaszivka", 0), ("Верхнє Верхнє", 0), ("Хокомине", 0), ("Нижнє Хокомине", 0),
        ("Дольша-Гора", 7), ("Гора Дольша", 7), ("Бж", 8), ("Довге Найменування Поселення Першотравневого Району Зелених Пагорбів", 9), ("Найменувана Довге Поселення Першотравневого Райнону Зелених Пагорбів", 9),
    ],
)
def test_token_sets(value, want):
    g = P.Gazetteer([*ENTRIES, (7, "Дольша Гора", None, None, None), (8, "Бож", None, None, None), (9, "Довге Найменування Поселення Першотравневого Району Зелених Пагорбів", None, None, None)])
    assert g.match(value, None) == want


@pytest.mark.parametrize(
    "value, hint, want",
    [
        ("Свечашівка школа", None, 1), ("explosion in Svechashivka", None, 1), ("вибух у Свечашівці, школа", None, 1), ("школа, Борушезопіль", "Світанська обл.", 2), ("школа, Борушезопіль", None, 0), ("Свечашівка школа, Свечашівка", None, 1),
        ("Свечашівка школа Зулкижеків", None, 0), ("траса школа Свечашівка", None, 0), ("школа Свечашівка 7", None, 0), ("північ Свечашівки", None, 0), ("north of Svechashivka", None, 0), ("Свечашівський район", None, 0), ("школа", None, 0), ("Верхня Свечашівка", None, 0),
    ],
)
def test_mentions_beside_other_words(g, value, hint, want):
    assert g.match(value, hint) == want


def test_edits():
    assert all(P.one_edit("abcd", x) for x in ("abcd", "abd", "abxcd", "abxd", "acbd", "bcd", "abcde")) and not any(P.one_edit("abcd", x) for x in ("ab", "badc", "abdce", "xbcx"))


def test_longest_name_wins():
    g = P.Gazetteer([(1, "Хокомине", None, None, "a"), (2, "Верхнє Хокомине", None, None, "a")])
    assert g.match("Верхнє Хокомине", None) == 2 and g.match("Хокомине", None) == 1


def test_rows(spark):
    v = spark.createDataFrame([(1, "Свечашівка", None), (1, "Свечашівка", None), (2, None, "x"), (3, "", None)], "id bigint, name string, hint string").selectExpr("*", "'c' AS _v", "1 AS name_uk")
    gaz = spark.createDataFrame(ENTRIES, "id int, name_uk string, name_ru string, name_en string, oblast string").selectExpr("*", "'c' AS hint")
    assert sorted((r["id"], r["gazetteer_id"]) for r in P.match_places(v, ("id",), "name", "hint", gaz).collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert {r["gazetteer_id"] for r in P.match_places(v, ("id",), "name", "hint", gaz.limit(0)).collect()} == {0}
    assert P.match_places(v.limit(0), ("id",), "name", "hint", gaz).count() == 0


def test_accuracy_on_known_entries(spark, data):
    e = table(spark, data, "extracted_events").where("gazetteer_id IS NOT NULL AND place_name_raw IS NOT NULL AND trim(place_name_raw) <> ''").selectExpr("id", "gazetteer_id AS known", "place_name_raw", "llm_raw.oblast AS hint")
    rows = P.match_places(e, ("id", "known"), "place_name_raw", "hint", table(spark, data, "gazetteer")).collect()
    assert rows and sum(r["known"] == r["gazetteer_id"] for r in rows) / len(rows) > 0.97


VALUES = [("Свечашівка", None), ("у Свечашівці", None), ("Борушезопіль", None), ("Борушезополі (Ольшанская обл.)", None), ("Хокомине Верхнє", None), ("верхна хокомина", None), ("Скрув’янове", None), ("Свечашівка, Зулкижеків", None), ("школа, Борушезопіль", "Світанська обл."), ("Верхня Свечашівка", None), ("explosion in Svechashivka", None), ("Зулкижекові", None), ("Свечашвка", None), ("школа", None), (None, "x"), ("", None)]


@pytest.mark.parametrize("part_entries", [1, 2, 4])
def test_parts_of_the_list_make_no_difference(spark, g, part_entries):
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(VALUES + VALUES[:3])], "id bigint, name string, hint string")
    gaz = spark.createDataFrame(ENTRIES, "id int, name_uk string, name_ru string, name_en string, oblast string")
    got = {r["id"]: r["gazetteer_id"] for r in P.match_places(v, ("id",), "name", "hint", gaz, part_entries).collect()}
    assert got == {i: g.match(*x) for i, x in enumerate(VALUES + VALUES[:3])}


@pytest.mark.parametrize("part_entries", [1, 100])
def test_unmatched_values_are_reported_with_the_closest_entry(spark, part_entries):
    v = spark.createDataFrame([("Хокомине", None), ("Хокомине", None), ("Борушезопіль", None), ("щось", None), (None, None), ("Свечашівка", None)], "name string, hint string")
    gaz = spark.createDataFrame(ENTRIES, "id int, name_uk string, name_ru string, name_en string, oblast string")
    got = {r["value"]: (r["n"], r["closest"], r["score"]) for r in P.report(v, "name", "hint", gaz, part_entries).collect()}
    assert got == {"Хокомине": (2, 4, pytest.approx(16 / 22, abs=1e-3)), "Борушезопіль": (1, 2, 1.0), "щось": (1, None, None), None: (1, None, None)}


def test_token_set_ratio():
    assert P.token_set_ratio(["верхнє", "хокомине"], ["хокомине", "верхнє"]) == 1.0 and P.token_set_ratio([], []) == 0.0
    assert P.token_set_ratio(["abcd"], ["abce"]) == 6 / 8 and P.token_set_ratio(["abcd", "xyz"], ["abcd"]) == 8 / 11 and P.token_set_ratio(["abcdef"], ["uvwxyz"]) == 0.0


def test_switching_a_method_off_changes_the_rows(monkeypatch):
    """Mentions come from the automaton, errors from the token sets: neither finds the other's."""
    mention, error = "explosion in Svechashivka", "Хокомнне Верхне"
    assert [P.Gazetteer(ENTRIES).match(x, None) for x in (mention, error)] == [1, 4]
    monkeypatch.setattr(P.Gazetteer, "_embedded", lambda *_: [])
    assert [P.Gazetteer(ENTRIES).match(x, None) for x in (mention, error)] == [0, 4]
    monkeypatch.undo()
    monkeypatch.setattr(P.Gazetteer, "_alike", lambda *_: [])
    assert [P.Gazetteer(ENTRIES).match(x, None) for x in (mention, error)] == [1, 0]
