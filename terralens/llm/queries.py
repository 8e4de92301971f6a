"""Queries of the problems about text, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.io import table
from terralens.llm import boilerplate, langid, leakage, mixing, mojibake, places, visual
from terralens.operators import stamps
from terralens.plans.stamps_sql import STAMPS


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news_items")
    model = langid.fit_word_model(news, "id", ("title", "body"), "lang")
    return langid.label_languages(news, ("id", "lang"), ("title", "body"), model)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in several languages or in another than their label names, with each language."""
    return langid.mislabelled(_labelled(spark, sf_dir), "id", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's segments with language and confidence (part 0 is the title, 1 the body)."""
    return langid.segments(_labelled(spark, sf_dir).withColumnRenamed("lang", "label"), ("id",))


def _p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "news_items").select(F.lit("news_items").alias("tbl"), F.col("id").alias("row_id"), F.col("title").alias("text"))
    return titles.unionByName(table(spark, sf_dir, "extracted_events").select(F.lit("extracted_events").alias("tbl"), F.col("id").alias("row_id"), F.col("place_name_raw").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and place names that hold characters other than they look."""
    texts = _p5_texts(spark, sf_dir)
    odd = visual.deviations(texts, "text").where(visual.is_deviant()).select("text")
    return texts.where(F.col("text").rlike(visual.SUSPICIOUS)).join(odd, "text", "left_semi").select("tbl", "row_id").distinct()


P5_SQL = r"""
WITH t AS (SELECT 'news_items' AS tbl, id AS row_id, title AS s FROM news_items UNION ALL SELECT 'extracted_events', id, place_name_raw FROM extracted_events),
w AS (SELECT tbl, row_id, unnest(regexp_extract_all(s, '[\p{L}\p{M}\p{Nd}\p{Cf}''’ʼ‘]+')) AS word FROM t WHERE s IS NOT NULL),
mixed AS (SELECT DISTINCT tbl, row_id FROM w WHERE regexp_matches(word, '\p{Latin}')::INT + regexp_matches(word, '\p{Cyrillic}')::INT + regexp_matches(word, '\p{Greek}')::INT > 1)
SELECT DISTINCT tbl, row_id FROM t WHERE regexp_matches(s, '[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FB00}-\x{FB06}]|\p{L}\p{M}|\p{Cf}|[^\P{Z} ]|\t')
UNION SELECT tbl, row_id FROM mixed"""


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and place name in the one form, with the key by which equal-looking ones are equal."""
    return visual.canonical_text(_p5_texts(spark, sf_dir), "text").select("tbl", "row_id", "canonical", visual.comparison_key(F.col("canonical")).alias("key"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the lines that a source repeats in 4 rows and 8 percent of its rows.

    The definition counts rows, so the operator's stricter demands (different documents, different days) are
    set to 1 here; the counts they rest on are made all the same.
    """
    return boilerplate.boilerplate_places(table(spark, sf_dir, "news_items"), "source_id", "id", "body", "fetched_at", min_clusters=1, min_days=1)


P6_SQL = r"""
WITH l AS (
  SELECT source_id, id, generate_subscripts(string_split(body, chr(10)), 1) AS line_no, unnest(string_split(body, chr(10))) AS raw FROM news_items WHERE body IS NOT NULL),
n AS (SELECT source_id, id, line_no, trim(regexp_replace(regexp_replace(lower(raw), '[ \t\x{00a0}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line FROM l),
t AS (SELECT source_id, count(*) AS total FROM news_items GROUP BY source_id),
f AS (SELECT source_id, line FROM n JOIN t USING (source_id) WHERE line <> '' GROUP BY source_id, line, total
      HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) >= 0.08 * total)
SELECT id, CAST(line_no AS BIGINT) AS line_no FROM n JOIN f USING (source_id, line)
"""


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's body without its source's boilerplate, days counted by arrival; ``p6_clean_published`` counts them by publication."""
    return boilerplate.without_boilerplate(table(spark, sf_dir, "news_items"), "source_id", "id", "body", "fetched_at").select("id", "clean_body", "lines_removed")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, day`` of the items: ``published_at`` as an instant, or ``fetched_at`` where that names none."""
    news = table(spark, sf_dir, "news_items")
    published = stamps.normalise_stamps(stamps.news_stamps(news, table(spark, sf_dir, "source_clock"))).select(F.col("row_key").cast("bigint").alias("item"), F.timestamp_seconds("sec").alias("published"))
    return news.select("id", "fetched_at").join(published, F.col("id") == F.col("item"), "left").select("id", F.coalesce("published", "fetched_at").alias("day"))


def p6_clean_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's body without its source's boilerplate, days counted by ``published_at``, or ``fetched_at`` where that names no instant."""
    news = table(spark, sf_dir, "news_items").select("id", "source_id", "body")
    return boilerplate.without_boilerplate(news, "source_id", "id", "body", "day", dates=_dates(spark, sf_dir)).select("id", "clean_body", "lines_removed")


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each source repeats, with the documents, publication days and rows they stand in, boilerplate told from republished articles."""
    news = table(spark, sf_dir, "news_items").select("id", "source_id", "body")
    return boilerplate.line_report(news, "source_id", "id", "body", "day", dates=_dates(spark, sf_dir)).withColumnRenamed("source", "source_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the text as it was, where it can be had."""
    docs = table(spark, sf_dir, "documents")
    return mojibake.restore(docs, "doc_id", "text", mojibake.learn(docs, "doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents any part of which is garbled or lost by a wrong encoding."""
    return p10_restored(spark, sf_dir).select("doc_id")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "eval_items"), "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items of which they hold 12 words in a row."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item's word shingles in one place, with words changed or not."""
    return leakage.contained_items(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "eval_items"), "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into."""
    return leakage.item_report(_leaks(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "doc_id")


_P8_GRAMS = """
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 11], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 10)) AS i) WHERE len(ws) >= 12)"""
P8_SQL = f"WITH {_P8_GRAMS} SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram"
P8_ITEMS_SQL = f"""
WITH {_P8_GRAMS}, p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram GROUP BY ALL)
SELECT item_id, count(doc_id) AS documents, coalesce(max(n), 0) AS most_passages FROM eval_items LEFT JOIN p USING (item_id) GROUP BY item_id"""

def _open_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "extracted_events").where("gazetteer_id IS NULL AND place_name_raw RLIKE '[^\\\\s\\\\u00a0\\\\u2000-\\\\u200f\\\\u202f\\\\u2060\\\\u3000\\\\ufeff]'")
    return events.select("id", "place_name_raw", F.col("llm_raw.oblast").alias("hint"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without an entry but with a place name: the entry it names, or 0."""
    return places.match_places(_open_places(spark, sf_dir), ("id",), "place_name_raw", "hint", table(spark, sf_dir, "gazetteer")).distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names that name no entry, with the entry most like each."""
    return places.report(_open_places(spark, sf_dir), "place_name_raw", "hint", table(spark, sf_dir, "gazetteer"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture of the sources to their target shares."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix_sources(mixing.counted(table(spark, sf_dir, "documents"), targets, "doc_id", "text"), targets, "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reached."""
    targets = table(spark, sf_dir, "mix_targets")
    counts = mixing.counted(table(spark, sf_dir, "documents"), targets, "doc_id", "text")
    return mixing.shares(mixing.mix_sources(counts, targets, "doc_id"), counts, targets)


P6_CLEAN_SQL = r"""
WITH l AS (
  SELECT source_id, id, floor(epoch(fetched_at) / 86400) AS day, generate_subscripts(string_split(body, chr(10)), 1) AS line_no, unnest(string_split(body, chr(10))) AS raw FROM news_items WHERE body IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[ \t\x{00a0}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line FROM l),
d AS (SELECT source_id, id, day, list_sort(list_distinct(list(line) FILTER (line <> ''))) AS lines FROM n GROUP BY ALL),
c AS (SELECT source_id, lines, count(*) AS copies, min(day) AS day FROM d WHERE len(lines) > 0 GROUP BY ALL),
x AS (SELECT source_id, unnest(lines) AS line, copies, day FROM c),
t AS (SELECT source_id, count(*) AS total FROM news_items GROUP BY source_id),
f AS (SELECT source_id, line FROM x JOIN t USING (source_id) GROUP BY source_id, line, total
      HAVING sum(copies) >= 4 AND sum(copies) >= 0.08 * total AND count(*) >= 2 AND count(DISTINCT day) >= 2),
k AS (SELECT n.id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (f.line IS NULL), '') AS clean_body, CAST(count(f.line) AS INTEGER) AS lines_removed FROM n LEFT JOIN f USING (source_id, line) GROUP BY n.id)
SELECT id, clean_body, coalesce(lines_removed, 0) AS lines_removed FROM news_items LEFT JOIN k USING (id)"""

#: Days of publication where the stamp names an instant, else of arrival.
_DATED = r"(SELECT n.* REPLACE (coalesce(to_timestamp(i.sec), n.fetched_at) AS fetched_at) FROM news_items n LEFT JOIN instants i ON i.tbl = 'news_items' AND i.row_key = CAST(n.id AS VARCHAR))"
P6_CLEAN_PUBLISHED_SQL = P6_CLEAN_SQL.replace("WITH l AS", f"WITH {STAMPS}, published AS {_DATED}, l AS", 1).replace("AS raw FROM news_items WHERE body", "AS raw FROM published WHERE body", 1)
P6_LINES_SQL = P6_CLEAN_PUBLISHED_SQL[: P6_CLEAN_PUBLISHED_SQL.index("f AS (SELECT")] + r"""f AS (SELECT source_id, line, CAST(sum(copies) AS BIGINT) AS rows, count(*) AS clusters, count(DISTINCT day) AS days, total AS source_rows FROM x JOIN t USING (source_id) GROUP BY source_id, line, total HAVING sum(copies) >= 4 AND sum(copies) >= 0.08 * total),
w AS (SELECT source_id, line, min(trim(raw, ' ')) AS line_text FROM n GROUP BY ALL)
SELECT source_id, line_text, rows, clusters, days, source_rows, clusters >= 2 AND days >= 2 AS boilerplate FROM f JOIN w USING (source_id, line)"""

QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p8_found": p8_found, "p8_items": p8_items, "p8_contained": p8_contained, "p10_found": p10_found, "p10_restored": p10_restored, "p1_found": p1_found, "p1_segments": p1_segments, "p5_found": p5_found, "p5_canonical": p5_canonical, "p6_found": p6_found, "p6_clean": p6_clean, "p6_lines": p6_lines, "p6_clean_published": p6_clean_published}
ORACLES = {"p6_clean": P6_CLEAN_SQL, "p6_clean_published": P6_CLEAN_PUBLISHED_SQL, "p6_lines": P6_LINES_SQL, "p5_found": P5_SQL, "p8_found": P8_SQL, "p8_items": P8_ITEMS_SQL, "p6_found": P6_SQL}
