"""Every query about text: those with SQL give DuckDB's rows, the others rows that hold by themselves."""

import pytest

from terralens.io import table
from terralens.llm import queries
from tests.queries import assert_same

LANGUAGES = {"uk", "ru", "en", "de", "pl"}
#: What a query without SQL must give on the smallest tables.
HOLDS = {
    "p1_found": lambda rows: len(rows) > 20 and {r["lang"] for r in rows} <= LANGUAGES and len({(r["id"], r["lang"]) for r in rows}) == len(rows),
    "p1_segments": lambda rows: len(rows) > 200 and all(r["lang"] in LANGUAGES and 0 < r["confidence"] <= 1 and r["first"] <= r["last"] and r["words"] > 0 for r in rows),
    "p3_found": lambda rows: len(rows) > 20 and len({r["id"] for r in rows}) == len(rows) and sum(r["gazetteer_id"] > 0 for r in rows) > 0.6 * len(rows),
    "p3_unmatched": lambda rows: len(rows) > 3 and all(r["n"] > 0 and (r["score"] is None) == (r["closest"] is None) for r in rows),
    "p5_canonical": lambda rows: len(rows) > 200 and all((r["canonical"] is None) == (r["key"] is None) for r in rows),
    "p8_contained": lambda rows: all(r["containment"] >= 0.5 and 0 < r["estimate"] <= 1 for r in rows),
    "p9_mixture": lambda rows: len(rows) > 10 and all(r["uses"] >= 1 for r in rows),
    "p9_shares": lambda rows: len(rows) == 13 and abs(sum(r["actual_share"] for r in rows) - 1) < 1e-6 and all(r["tokens"] <= r["available"] * 6 and r["wanted"] == r["budget"] + r["shortfall"] for r in rows),
    "p10_found": lambda rows: len(rows) > 0,
    "p10_restored": lambda rows: len(rows) > 0 and all(r["hits"] > 0 or r["lost"] for r in rows),
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    if name in queries.ORACLES:
        assert_same(spark, data, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert HOLDS[name](queries.QUERIES[name](spark, data).collect())


def test_every_matched_place_and_every_used_document_exists(spark, data):
    known = {r[0] for r in table(spark, data, "gazetteer").select("id").collect()} | {0}
    assert {r["gazetteer_id"] for r in queries.p3_found(spark, data).collect()} <= known
    repeats = {r["source"]: r["max_repeats"] for r in table(spark, data, "mix_targets").collect()}
    assert all(r["uses"] <= repeats[r["source"]] for r in queries.p9_mixture(spark, data).collect())
