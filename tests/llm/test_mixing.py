"""Mixtures: shares, caps, prefix order, and the distributed cut against one sorted pass."""

import os

import pytest
from pyspark.sql import functions as F

from terralens.llm import mixing as M


def frames(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    return d.selectExpr("*", "'x' AS uses", "0 AS epochs"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(10_000 + i, "b", 7) for i in range(50)] + [(20_000, "other", 5)]
    d, t = frames(spark, docs, [("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 3)])
    exact = M.plan_mix(d, t).first()["exact_total"]
    assert exact == 350 * 4 * 8 // 3
    rows = {r["source"]: r for r in M.shares(M.mix_sources(d, t, "doc_id", total_tokens=exact), d, t, exact).collect()}
    assert rows["none"]["tokens"] == 0 and "other" not in rows
    assert rows["a"]["actual_share"] == pytest.approx(0.5 / 0.8, abs=0.01) and rows["b"]["actual_share"] == pytest.approx(0.3 / 0.8, abs=0.01)
    assert rows["a"]["most_uses"] <= 1 and rows["b"]["most_uses"] == 4


def test_a_source_that_falls_short_does_not_shrink_the_others(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(10_000 + i, "b", 7) for i in range(50)]
    d, t = frames(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.2, 3)])
    rows = {r["source"]: r for r in M.shares(M.mix_sources(d, t, "doc_id"), d, t).collect()}
    assert (rows["a"]["wanted"], rows["a"]["shortfall"], rows["b"]["wanted"], rows["b"]["budget"], rows["b"]["shortfall"]) == (5175, 0, 5175, 700, 4475)
    assert abs(rows["a"]["tokens"] - 5175) <= 5 and rows["b"]["tokens"] == 700 and rows["b"]["most_uses"] == 2 and rows["none"]["wanted"] == 0


def test_cut_equals_one_sorted_pass(spark):
    docs = [(i, "a", 1 + i * 37 % 90) for i in range(3000)]
    d, t = frames(spark, docs, [("a", 1.0, 3)])
    got = {r["doc_id"]: r["uses"] for r in M.mix_sources(d, t, "doc_id", seed=3, total_tokens=150_000).collect()}
    total = sum(n for _, _, n in docs)
    epochs, left = divmod(150_000, total)
    want, run = {}, 0
    for i, n in d.orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 52), F.xxhash64(F.lit(3), "doc_id")).select("doc_id", "n_tokens").collect():
        uses = epochs + (run + n / 2 <= left)
        run += n
        if uses:
            want[i] = uses
    assert got == want and abs(sum(dict((i, n) for i, _, n in docs)[i] * u for i, u in got.items()) - 150_000) <= 45


def test_odd_inputs(spark):
    d, t = frames(spark, [(1, "a", 0), (2, "a", 5), (2, "a", 5), (3, None, 5), (None, "a", 1)], [("a", 1.0, 2), ("a", None, None), (None, 0.5, 1)])
    assert M.mix_sources(d, t, "doc_id").count() >= 3
    assert M.mix_sources(d.limit(0), t, "doc_id").count() == 0
    assert M.mix_sources(d, t.limit(0), "doc_id").count() == 0
    assert M.shares(M.mix_sources(d.limit(0), t, "doc_id"), d.limit(0), t).where("tokens > 0").count() == 0


def test_tokens(spark):
    if not os.path.exists(M.TOKENIZER):
        pytest.skip("no tokenizer here")
    d = spark.createDataFrame([(1, "Hello world, hello"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "слово " * 20_000)], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in M.with_tokens(d, ("doc_id",), "text").collect()}
    assert n[1] >= 4 and n[2] == n[3] == 0 and n[4] > 1 and n[5] >= 20_000
