"""Text that looks the same brought to one form.

Texts are exploded to positioned code points; broadcast joins with tables computed from the Unicode data
give each its decomposition and, by the dominating script of its word, its look-alike; combining marks are
ordered by class, letters recomposed and the strings rebuilt. Only texts that hold a code point or a mixture
the tables can change are exploded: for any other the result is the text itself, which is exact. Equal texts
are exploded once.

A word wholly in look-alikes of another script shows no mixture, so ``comparison_key`` reduces every letter that has
a look-alike to one of its group: texts that look alike have equal keys.

Tables. They are derived from ``unicodedata`` by rule, over all of Unicode but ideographs and Hangul syllables, and bounded
by it (some ten thousand rows), so broadcasting them is safe at any input size.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters that look alike, a group each: Latin first, then other scripts.
LOOKALIKES = """
aаα cсϲ dԁ eеҽ gց hһհ iіι jјϳյ kкκ lӏ nո oоοօ pрρ qԛզ sѕ uυս vѵν wԝա xхχ yуγ
AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ GԌᏀ HНΗᎻ IІΙӀ JЈᎫ KКΚᏦ LᏞԼ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ RᎡ SЅՏᏚ TТΤᎢ UՍ VѴᏙ WԜᎳ XХΧ YУΥ ZΖᏃ
"""
SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "CHEROKEE": "R", "HEBREW": "H", "ARABIC": "B"}
#: Other alphabets and syllabaries of which a letter beside those above makes a mixed word.
OTHER_SCRIPTS = set("""
GEORGIAN DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR ETHIOPIC KHMER MONGOLIAN
COPTIC GLAGOLITIC GOTHIC SYRIAC THAANA NKO RUNIC OGHAM LISU DESERET TIFINAGH BOPOMOFO VAI OSAGE ADLAM
""".split())
APOSTROPHES = "'‘’ʼʹ′´`＇՚"


@lru_cache(maxsize=200_000)
def _script(ch: str) -> str | None:
    if unicodedata.category(ch)[0] != "L":
        return None
    words = unicodedata.name(ch, "").split()[:2]
    return next((SCRIPTS.get(w, w) for w in words if w in SCRIPTS or w in OTHER_SCRIPTS), None)


def _listed() -> list[str]:
    """All assigned characters but ideographs and Hangul syllables."""
    return [c for c in map(chr, range(32, 0x110000)) if not ("\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\U00020000" <= c <= "\U0003ffff") and unicodedata.category(c) not in ("Cn", "Cs", "Co")]


def _kind(ch: str) -> str | None:
    """What makes a code point a deviation by itself."""
    category, how = unicodedata.category(ch), unicodedata.decomposition(ch)
    if category == "Cf" or ch in "͏ᅟᅠㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or "᠋" <= ch <= "᠏":
        return "invisible"
    if (category[0] == "Z" and ch != " ") or ch in "\t\x0b\x0c\x85":
        return "space"
    if category in ("Mn", "Me"):
        return "mark"
    if category[0] in "LN" and how.split(" ")[0] in ("<wide>", "<narrow>", "<compat>", "<font>") and (category[0] == "L" or how.split(" ")[0] in ("<wide>", "<font>")):
        return "form"
    return None


@lru_cache(maxsize=1)
def code_points() -> list[tuple]:
    """Rows ``ch, kind, letter, joins, parts`` of every code point that can matter; ``parts`` is its decomposition.

    ``parts`` are ``(ch, ccc, script)``: nothing for an invisible one, an ordinary space for another space,
    the compatibility letters for a full-width or joined form, else the canonical decomposition. A code point that is no
    row parts words and stands for itself.
    """
    rows = []
    for ch in ["\t", "\x0b", "\x0c", "\x85", *_listed()]:
        category, kind = unicodedata.category(ch), _kind(ch)
        joins = category[0] in "LM" or category == "Nd" or ch in APOSTROPHES or kind == "invisible"
        if kind == "invisible":
            parts = ""
        elif kind == "space":
            parts = " "
        elif ch in APOSTROPHES:
            parts = "'"
        elif kind == "form" or "<wide>" in unicodedata.decomposition(ch):
            parts = unicodedata.normalize("NFKD", ch)
        else:
            parts = unicodedata.normalize("NFD", ch)
        if joins or kind or parts != ch:
            rows.append((ch, kind, category[0] == "L", joins, [(p, unicodedata.combining(p), _script(p)) for p in parts]))
    return rows


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """``(canonical decomposition, composed letter)`` of every letter that Unicode composes."""
    found = {}
    for ch in _listed():
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
            found[parts] = ch
    return sorted(found.items())


@lru_cache(maxsize=1)
def lookalikes() -> list[tuple[str, str, str]]:
    """``(letter, wanted script, the look-alike of that script)``."""
    rows = []
    for group in LOOKALIKES.split():
        first = {_script(c): c for c in reversed(group)}
        rows += [(a, s, b) for a in group for s, b in first.items() if s != _script(a)]
    return rows


def comparison_key(canonical: Column) -> Column:
    """A text in the one form with each letter that has look-alikes as the Latin one of its group; for comparing, not for reading.

    Equal-looking texts have equal keys, even where a whole word is written in another script's letters. Null stays null.
    """
    letters = [(c, group[0]) for group in LOOKALIKES.split() for c in group[1:]]
    return F.translate(canonical, "".join(a for a, _ in letters), "".join(b for _, b in letters))


#: Whatever lies outside these, or mixes scripts within a word, may change; everything else is in its one form.
PLAIN = r"\x20-\x26\x28-\x5F\x61-\x7EЀ-џҐґÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž'«»“”„–—…№·•"
LATIN, CYRILLIC = r"[A-Za-zÀ-ÖØ-öø-ž]", r"[Ѐ-ґ]"
SUSPICIOUS = rf"[^{PLAIN}]|{LATIN}[0-9']*{CYRILLIC}|{CYRILLIC}[0-9']*{LATIN}"
FLAGS = ("form", "accent", "invisible", "space", "mixed")


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    marks = spark.createDataFrame(code_points(), "ch string, kind string, letter boolean, joins boolean, parts array<struct<c:string,ccc:int,script:string>>")
    return F.broadcast(marks), F.broadcast(spark.createDataFrame(lookalikes(), "c string, main string, twin string")), F.broadcast(spark.createDataFrame(compositions(), "s string, composed string"))


def deviations(texts: DataFrame, text: str) -> DataFrame:
    """``text, canonical`` and one boolean per entry of ``FLAGS`` for each distinct text that is not in the one form.

    ``form``: a full-width or joined letter form; ``accent``: a letter with its accent apart; ``invisible``;
    ``space``: not the ordinary one; ``mixed``: a letter of another script than most of its word (hyphens
    part words; apostrophes and digits don't). Null and empty texts have no deviation.
    """
    marks, twins, composed = _tables(texts.sparkSession)
    odd = texts.where(F.col(text).rlike(SUSPICIOUS)).select(F.col(text).alias("_text")).distinct().withColumns({"_h": F.xxhash64("_text"), "_g": F.hash("_text")})
    cps = odd.select("_h", "_g", F.posexplode(F.regexp_extract_all("_text", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    key = ["_h", "_g"]
    order = Window.partitionBy(*key).orderBy("pos")
    cps = (
        cps.join(marks, "ch", "left")
        .withColumn("word", F.sum((~F.coalesce("joins", F.lit(False))).cast("int")).over(order))
        .withColumn("accent", (F.col("kind") == "mark") & F.lag(F.coalesce(F.col("letter") | (F.col("kind") == "mark"), F.lit(False))).over(order))
        .withColumn("parts", F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(None).cast("string").alias("script")))))
        .select(*key, "pos", "kind", "accent", "word", F.posexplode_outer("parts").alias("sub", "p"))
        .select(*key, "pos", "kind", "accent", "word", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("p.c", F.lit("")).alias("c"), F.coalesce("p.ccc", F.lit(0)).alias("ccc"), "p.script")
    )
    word = Window.partitionBy(*key, "word")
    #: Letters without a twin (of Latin and Cyrillic ones: in the other) decide; then the number of letters.
    twinned = {a for a, s, _ in lookalikes() if _script(a) not in ("L", "C") or {s, _script(a)} == {"L", "C"}}
    own = F.when(F.col("c").isin(sorted(twinned)), 1).otherwise(100)
    scripts = {s: F.sum(F.when(F.col("script") == s, own).otherwise(0)).over(word) for s in SCRIPTS.values()}
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(s).alias("s")) for s, n in scripts.items()]))
    cps = cps.withColumns({"main": best["s"], "mixed": F.size(F.collect_set("script").over(word)) > 1})
    cps = cps.join(twins, ["c", "main"], "left").withColumn("c", F.when(F.col("mixed"), F.coalesce("twin", "c")).otherwise(F.col("c")))
    cps = cps.withColumn("base", F.sum(F.when((F.col("ccc") == 0), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("pos", "sub")))
    flag = {"form": F.col("kind") == "form", "accent": F.col("accent"), "invisible": F.col("kind") == "invisible", "space": F.col("kind") == "space", "mixed": F.col("mixed")}
    letters = cps.groupBy(*key, "base").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c"))), lambda x: x["c"]), "").alias("s"),
        *[F.max(F.coalesce(v, F.lit(False))).alias(k) for k, v in flag.items()],
    )
    letters = letters.join(composed, "s", "left").withColumn("s", F.coalesce("composed", "s")).drop("composed")
    #: A letter with several accents of which only the first composes.
    first = composed.withColumnsRenamed({"s": "_s2", "composed": "_c2"})
    letters = letters.withColumn("_s2", F.when(F.length("s") > 2, F.substring("s", 1, 2))).join(first, "_s2", "left")
    letters = letters.withColumn("s", F.when(F.col("_c2").isNotNull(), F.concat("_c2", F.expr("substring(s, 3)"))).otherwise(F.col("s")))
    strings = letters.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "s"))), lambda x: x["s"]), "").alias("canonical"), *[F.max(k).alias(k) for k in flag]
    )
    return odd.join(strings, key).select(F.col("_text").alias(text), "canonical", *FLAGS)


def is_deviant() -> Column:
    """True where ``deviations`` found more than apostrophes."""
    return F.greatest(*[F.col(k).cast("int") for k in FLAGS]) > 0


def canonical_text(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` plus ``out``: ``text`` in the form in which texts that look alike are equal; null stays null.

    Rows and other columns stay as they are; a column ``out`` of ``df`` is replaced.
    """
    odd = deviations(df.select(text), text).select(F.col(text).alias("_terralens_text"), F.col("canonical").alias("_terralens_form"))
    return df.join(odd, F.col(text) == F.col("_terralens_text"), "left").withColumn(out, F.coalesce("_terralens_form", text)).drop("_terralens_text", "_terralens_form")
