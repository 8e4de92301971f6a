"""Text decoded with the wrong encoding: found, and restored where nothing was lost.

Lines that look garbled are joined with clean near-twins on the text stripped of non-ASCII characters (and of
question marks, which stand for lost letters). The characters of the two lines align one to one or one to a
fixed group; each *transformation* (the encoding a text was shown in and the one it was written in, once or
twice over) that turns the garbled characters into the clean ones gets the pair's vote. The transformations
learnt that way are then applied to the tokens of all records: a token counts as garbled where a learnt
transformation makes it far more probable under a letter-pair model of the corpus's own clean words.

Scale. Garbled lines are few; a clean line is shuffled only if its skeleton is one of theirs. Each distinct garbled
line meets all distinct clean lines of its skeleton, spread over ``SALTS`` parts, and votes once for a
transformation. Transformations are at most some hundred. Records are restored row by row, without a shuffle. Texts
pass through Arrow, for Python's character classes are ten times as fast here as the JVM's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.io import checkpointed, ship_package
from terralens.llm.bitmap import bitmap, marked

#: Encodings a text may have been shown in, and written in. Names are Python's; ``western`` is cp1252 or latin-1.
SHOWN = ("western", "cp1251", "koi8_r", "koi8_u", "cp866", "cp437", "cp850", "cp852", "cp1250", "iso8859_2", "iso8859_5", "mac_cyrillic", "mac_roman", "iso8859_15")
WRITTEN = ("utf_8", "cp1251", "koi8_u", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1252", "iso8859_5", "mac_cyrillic", "cp852")
#: A letter pair is known if it is counted once in so many documents on average, or at all in fewer.
PER_ROWS = 4000
#: Distinct words of a task that are counted before their letter pairs are.
WORDS_HELD = 200_000
#: Parts that a skeleton's clean sentences are spread over.
SALTS = 8
#: Votes that a transformation needs; nats by which a token must become more probable, in all and a character.
MIN_VOTES, GAIN, GAIN_PER_CHAR = 2, 6.0, 0.8
#: Letters that a map of letters must have, and uses of them in a sentence.
MAP_LETTERS, MAP_USES = 12, 24
UPPER, LOWER = "А-ЯЁІЇЄҐ", "а-яёіїєґ"
LETTERS = f"{UPPER}{LOWER}ÄÖÜäöüßĄąĆćĘęŁłŃńÓóŚśŹźŻż"
#: A line without these holds nothing that a transformation could explain.
SUSPICIOUS = rf"[^\x00-\x7E{LETTERS}«»„“”‘’–—…№]|[{LOWER}][{UPPER}]|[{UPPER}]{{4}}|‘|[„“”’–—…«»№][{LETTERS}„“”’–—…«»№]*[„“”’–—…«»№]"
TOKEN = re.compile(r"[A-Za-z\u0080-\U0010FFFF]+")
CLEAN_WORD = re.compile(rf"^(?:[{UPPER}]?[{LOWER}]+|[A-ZÄÖÜĆŁÓŚŹŻ]?[a-zäöüßąćęłńóśźż]+)$")
#: Letters lost to a replacement character, or to question marks: within or before a word, or word after word.
LOST = rf"�|[A-Za-z{LETTERS}]\?+[A-Za-z{LETTERS}]|(?:^|[\s(«„\"-])\?+[a-z{LOWER}{UPPER}]|(?:^|\s)\?+[,.:;]?\s+(?:[^\s]{{1,12}}\s+)?\?+(?:[\s,.:;!)-]|$)|\?{{4,}}"
URL = r"(?i)\b(?:https?://|www\.)\S+"


#: Tokens of more characters are tried whole and then in pieces, and not remembered.
LONG = 400
BREAKS = re.compile("([\u00a0\u2010-\u2015«»„“”‘’…]+)")
WORDS = re.compile(r"[^\W\d_]+")
#: Characters beside letters and ASCII that the corpus's clean texts use.
PUNCTUATION = "«»„“”‘’–—…№·|°±£€§\u00a0"


def _pairs(low: str) -> list[str]:
    """Letter pairs of a word in small letters, with its ends marked."""
    return ["^" + low[0], *(low[i : i + 2] for i in range(len(low) - 1)), low[-1] + "$"]


@lru_cache(maxsize=64)
def _bytes_of(shown: str) -> dict[str, int]:
    """Byte behind each character of a one-byte encoding; undefined bytes were shown as control characters."""
    table: dict[str, int] = {}
    if shown == "western":
        table = {chr(b): b for b in range(128, 256)}
        shown = "cp1252"
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(shown)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def undo(text: str, shown: str, written: str) -> str | None:
    """``text`` shown in ``shown`` as it was written in ``written``, or null if it can't have been."""
    table = _bytes_of(shown)
    try:
        return bytes(table[c] if c > "\x7f" else ord(c) for c in text).decode(written)
    except (KeyError, UnicodeDecodeError):
        return None


#: Steps ``(shown, written)``; a step ``("map", letters)`` of a learnt map has its pairs as text, garbled and clean letters in turn.
Transformation = tuple[tuple[str, str], ...]


@lru_cache(maxsize=1)
def transformations() -> list[Transformation]:
    """All transformations that are tried: one step, or UTF-8 shown wrongly twice."""
    once: list[Transformation] = [((a, b),) for a in SHOWN for b in WRITTEN if a != b and (a, b) != ("western", "cp1252")]
    return once + [((a, "utf_8"), (b, "utf_8")) for a in SHOWN[:4] for b in SHOWN[:4]]


def apply(text: str, how: Transformation) -> str | None:
    """``text`` after all steps of ``how``; null if one is impossible."""
    for shown, written in how:
        if text is not None:
            text = _by_map(text, written) if shown == "map" else undo(text, shown, written)
    return text


@lru_cache(maxsize=64)
def _table(letters: str) -> dict[str, str]:
    return dict(zip(letters[::2], letters[1::2]))


def _by_map(text: str, letters: str) -> str | None:
    """``text`` by a learnt map of letters; null if it has a letter that the map lacks."""
    table = _table(letters)
    return "".join(c if c < "\x80" else table[c] for c in text) if all(c < "\x80" or c in table for c in text) else None


#: Shown in these, valid UTF-8 of more than ASCII is no accident: known letter pairs are not asked for.
LATIN = {"western", "iso8859_15", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850", "cp852"}


def _readable(text: str) -> bool:
    """Latin and Cyrillic letters and ordinary punctuation only."""
    return all(c.isascii() or c in PUNCTUATION or (c.isalpha() and c < "\u0530" and not "\u0250" <= c < "\u0400") for c in text)


def _mixed(text: str) -> bool:
    """Latin letters beside Cyrillic ones."""
    return any("a" <= c.lower() <= "z" for c in text) and any("\u0400" <= c < "\u0530" for c in text)


def _letters_stay(old: str, new: str) -> bool:
    """One letter for one letter: between one-byte encodings a letter of a word does not become a sign."""
    return len(old) == len(new) and all(b.isalpha() for a, b in zip(old, new) if a.isalpha())


@dataclass(frozen=True)
class LetterModel:
    """Letter pairs of clean words, and the transformations that the corpus showed."""

    pairs: dict[str, float]
    floor: float
    learnt: tuple[Transformation, ...] = ()
    seen: dict = field(default_factory=dict, compare=False)

    def score(self, token: str) -> float:
        """Log probability of a token: its words' letter pairs, less for capitals amid small letters and for symbols."""
        s = 0.0
        for w in WORDS.findall(token):
            low = w.lower()
            s += sum(self.pairs.get(p, self.floor) for p in _pairs(low)) - 3.0 * sum(x.islower() and y.isupper() for x, y in zip(w, w[1:]))
        return s + sum(-0.5 if c in PUNCTUATION else self.floor for c in token if not c.isalpha())

    def plausible(self, text: str) -> bool:
        """True for known letter pairs (one of six may be new), one script a word and ordinary punctuation."""
        for w in WORDS.findall(text):
            pairs = _pairs(w.lower())
            if sum(p not in self.pairs for p in pairs) * 6 > len(pairs) or (any(c < "\u0250" for c in w) and any(c >= "\u0250" for c in w)):
                return False
        return all(c in PUNCTUATION for c in text if not c.isalpha())

    def restored(self, token: str) -> tuple[str, Transformation] | None:
        """The token as it was written and how, if it is garbled; found once for each token."""
        if len(token) > LONG:
            return self._restored(token) or (self._pieces(token) if BREAKS.search(token) else None)
        if token not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[token] = self._restored(token)
        return self.seen[token]

    def _restored(self, token: str) -> tuple[str, Transformation] | None:
        if token.isascii():
            return None
        old, best = self.score(token), None
        for how in self.learnt:
            new = apply(token, how)
            if not new or new == token:
                continue
            single = how[0][1] != "utf_8"
            words = WORDS.findall(new)
            if single and (not words or len(new) < 3 or not _letters_stay(token, new) or CLEAN_WORD.match(token)):
                continue
            if not self.plausible(new) and not (not single and _readable(new) and (how[0][0] in LATIN or (_mixed(token) and not _mixed(new)))):
                continue
            gain = self.score(new) - old
            if gain >= GAIN and gain >= GAIN_PER_CHAR * len(token) and (best is None or gain > best[0]):
                best = (gain, new, how)
        return best and best[1:]


    def _pieces(self, token: str) -> tuple[str, Transformation] | None:
        """A long token restored between its clean words, or between its blanks, dashes and quotes; null if no part is garbled.

        A blank or quote may be half of a garbled letter, so the parts between two clean words are tried together first.
        """
        out: list[str] = []
        how: Transformation | None = None
        group: list[str] = []
        for piece in [*BREAKS.split(token), None]:
            if piece is not None and not (len(piece) > 2 and CLEAN_WORD.match(piece)):
                group.append(piece)
                continue
            for part in self._spans(group, token):
                found = self.restored(part) if part != token and not part.isascii() else None
                out.append(found[0] if found else part)
                how = how or (found and found[1])
            group = []
            out.append(piece or "")
        return how and ("".join(out), how)

    def _spans(self, group: list[str], token: str) -> list[str]:
        """``group`` as one garbled part, its ends apart if they are blanks or quotes; piece by piece if that is none."""
        whole = "".join(group)
        lead = len(whole) - len(BREAKS.sub("", whole, count=1)) if BREAKS.match(whole) else 0
        end = BREAKS.split(whole)[-2] if whole and BREAKS.split(whole)[-1] == "" and len(whole) > lead else ""
        for a in dict.fromkeys((0, lead)):
            for b in dict.fromkeys((len(whole), len(whole) - len(end))):
                if whole[a:b] and whole[a:b] != token and self._restored(whole[a:b]):
                    return [whole[:a], whole[a:b], whole[b:]]
        return group

    def restore(self, text: str) -> tuple[str, int]:
        """``text`` with its garbled tokens restored, and how many had enough evidence of their own.

        Short tokens seldom have. Beside such a token of the same line (at most two away) they follow its
        transformation if that makes them more probable.
        """
        hits, lines = 0, []
        for line in text.split("\n"):
            if line.isascii():
                lines.append(line)
                continue
            tokens = list(TOKEN.finditer(line))
            found = [self.restored(m[0]) for m in tokens]
            if any(found):
                hits += sum(f is not None for f in found)
                how_at = [f and f[1] for f in found]
                for i, m in enumerate(tokens):
                    if found[i] is None and not m[0].isascii():
                        for how in dict.fromkeys(h for h in how_at[max(0, i - 2) : i + 3] if h):
                            new = apply(m[0], how)
                            if new and (how[0][1] == "utf_8" or _letters_stay(m[0], new)) and self.score(new) > self.score(m[0]):
                                found[i] = (new, how)
                                break
                parts, at = [], 0
                for m, f in zip(tokens, found):
                    parts += [line[at : m.start()], f[0] if f else m[0]]
                    at = m.end()
                line = "".join(parts) + line[at:]
            lines.append(line)
        return "\n".join(lines), hits


def _pair_counts(words: Counter) -> Counter:
    """Letter pairs of the clean ones of counted words."""
    pairs: Counter = Counter()
    for w, n in words.items():
        if CLEAN_WORD.match(w):
            for p in _pairs(w.lower()):
                pairs[p] += n
    return pairs


def _letter_scores(pairs: dict[str, int], docs: int) -> tuple[dict[str, float], float]:
    """Log probabilities of letter pairs by their counts in ``docs`` documents, taken as of ``PER_ROWS`` so that chance pairs of a large corpus stay unknown."""
    each = max(1.0, docs / PER_ROWS)
    first: Counter = Counter()
    for p, n in pairs.items():
        first[p[0]] += n / each
    return {p: math.log(n / each / (first[p[0]] + 60)) for p, n in pairs.items() if n >= each}, -9.0


def _letters(rows: list[str]) -> tuple[dict[str, float], float]:
    """The letter scores of some texts."""
    return _letter_scores(_pair_counts(Counter(w for text in rows for w in set(TOKEN.findall(text)))), len(rows))


def _runs(text: str) -> list[str]:
    return re.findall(r"[\u0080-\U0010FFFF]+", text)


@lru_cache(maxsize=20_000)
def _explaining(garbled: str) -> dict[str, tuple[int, ...]]:
    """What a run may have been, with the numbers of the transformations that make it so."""
    found: dict[str, tuple[int, ...]] = {}
    for k, how in enumerate(transformations()):
        if (clean := apply(garbled, how)) is not None:
            found[clean] = (*found.get(clean, ()), k)
    return found


def _map_of(pairs: list[tuple[str, str]]) -> dict[str, str] | None:
    """The map of letters that turns each run into its counterpart, if there is one and only one way round; null if not."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for x, y in pairs:
        if len(x) != len(y):
            return None
        for c, d in zip(x, y):
            if there.setdefault(c, d) != d or back.setdefault(d, c) != c:
                return None
    return there


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``unit, how, letters``: what each garbled sentence's alignments with its clean twins say.

    Runs between the same ASCII characters align, one character to one or to a fixed group. A near-twin may differ in
    a name, so not all runs that differ need to agree, but three of four must, among them eight characters or two
    runs: then the encodings that explain them are named (``how``). Where no encodings explain any, and the runs align
    letter by letter to one map of at least ``MAP_LETTERS`` letters, used ``MAP_USES`` times, its pairs are given (``letters``).
    """
    for pdf in batches:
        votes: set[tuple[int, int, str]] = set()
        for garbled, clean in zip(pdf["garbled"], pdf["clean"]):
            a, b = _runs(garbled), _runs(clean)
            pairs = [(x, y) for x, y in zip(a, b) if x != y] if len(a) == len(b) else []
            good: Counter = Counter()
            size: Counter = Counter()
            for x, y in pairs:
                for k in _explaining(x).get(y, ()):
                    good[k] += 1
                    size[k] += len(y)
            for k, n in good.items():
                if n >= 0.75 * len(pairs) and (n >= 2 or size[k] >= 8):
                    votes.add((_hash(garbled), k, ""))
            if not good and sum(len(x) for x, _ in pairs) >= MAP_USES and (found := _map_of(pairs)) and len(found) >= MAP_LETTERS and all(c.isalpha() for c in found.values()):
                votes |= {(_hash(garbled), -1, c + d) for c, d in found.items()}
        yield pd.DataFrame(sorted(votes), columns=["unit", "how", "letters"]).astype({"unit": "int64", "how": "int64"})


SENTENCE = re.compile(r"\n|(?<=[.!?…])\s+")
ODD = re.compile(SUSPICIOUS)
_NO_LETTER = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())


def _hash(text: str | bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def _marked(unit: str) -> bytes:
    """A sentence with a question mark for each character that is not ASCII."""
    return unit.encode("ascii", "replace")


def _skeleton(unit: str) -> int:
    """Hash of a garbled sentence stripped of its non-ASCII characters (and of question marks, which stand for lost ones).

    With few ASCII letters left (Cyrillic) too many sentences would share a skeleton, so there each stripped
    character leaves a mark.
    """
    marked = _marked(unit)
    bare = marked.replace(b"?", b"")
    return _hash(bare if len(bare.translate(None, _NO_LETTER)) >= 10 else marked)


def _skeletons(unit: str) -> tuple[int, int, int]:
    """The skeletons that a clean sentence may have when garbled: its letters gone, or each one or two characters."""
    marked = _marked(unit)
    return _hash(marked.replace(b"?", b"")), _hash(marked), _hash(marked.replace(b"?", b"??"))


def _units(text: str, odd: bool) -> list[str]:
    """Sentences with a non-ASCII character that look garbled (``odd``) or clean."""
    if text.isascii():
        return []
    some = ODD.search(text) is not None
    if odd and not some:
        return []
    return [u for u in SENTENCE.split(text) if not u.isascii() and (some and ODD.search(u) is not None) == odd]


def _garbled_and_pairs(docs: DataFrame, text: str) -> DataFrame:
    """``skeleton, unit, n``: distinct sentences that look garbled (``n`` is null), and the letter pairs of all clean words.

    Pairs have no skeleton; ``n`` is how many different words of a document have them, over all documents, and for the
    unit "" the number of documents. One pass serves both.
    """
    ship_package(docs.sparkSession)

    def counted(words: Counter, number: int) -> pd.DataFrame:
        pairs = _pair_counts(words)
        return pd.DataFrame({"skeleton": pd.array([None] * (len(pairs) + 1), dtype="Int64"), "unit": [*pairs, ""], "n": pd.array([*pairs.values(), number], dtype="Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        number = 0
        for pdf in batches:
            found: list[str] = []
            for t in pdf["t"]:
                number += t != ""
                words.update(set(TOKEN.findall(t)))
                found += _units(t, True)
                if len(words) > WORDS_HELD:
                    yield counted(words, number)
                    words, number = Counter(), 0
            yield pd.DataFrame({"skeleton": pd.array([_skeleton(u) for u in found], dtype="Int64"), "unit": np.array(found, dtype=object), "n": pd.array([None] * len(found), dtype="Int64")})
        yield counted(words, number)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "skeleton bigint, unit string, n bigint")
    return rows.groupBy("skeleton", "unit").agg(F.sum("n").alias("n"))


def _clean_sentences(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """``skeleton, unit`` of the clean sentences with a non-ASCII character, of the skeletons that the bitmap ``wanted`` marks."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [u for t in pdf["t"] for u in _units(t, False)]
            k = np.array([k for u in units for k in _skeletons(u)], dtype=np.int64)
            at = np.flatnonzero(marked(shared.value, k.view(np.uint64)))
            yield pd.DataFrame({"skeleton": k[at], "unit": np.array([units[i // 3] for i in at], dtype=object)})

    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "skeleton bigint, unit string")


def learn(docs: DataFrame, doc: str, text: str, min_votes: int = MIN_VOTES) -> LetterModel:
    """The letter model and the transformations of ``docs``, both from all of them, whatever their keys ``doc``.

    A transformation needs ``min_votes`` garbled sentences; what was done once to UTF-8 may have been done twice, so the
    repetition of a learnt step counts as learnt, and no other succession does without votes. Maps of letters that no encodings explain are put together
    from the pairs that as many sentences show, each letter's most frequent counterpart, if three of four agree.
    """
    seen = checkpointed(_garbled_and_pairs(docs, text))
    #: At most as many rows as the letters of clean words have pairs.
    pairs = {r["unit"]: r["n"] for r in seen.where("skeleton IS NULL").select("unit", "n").collect()}
    number = pairs.pop("", 0)
    garbled = seen.where("skeleton IS NOT NULL").select("skeleton", F.col("unit").alias("garbled"))
    clean = _clean_sentences(docs, text, bitmap(garbled, "skeleton"))
    clean = clean.distinct().select("skeleton", F.col("unit").alias("clean"), F.pmod(F.xxhash64("unit"), F.lit(SALTS)).alias("salt"))
    salted = garbled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    votes = salted.join(clean, ["skeleton", "salt"]).select("garbled", "clean").mapInPandas(_vote, "unit bigint, how bigint, letters string").distinct().groupBy("how", "letters").agg(F.count(F.lit(1)).alias("votes"))
    #: At most as many rows as there are transformations, and as pairs of letters.
    counted = votes.where(F.col("votes") >= min_votes).orderBy(F.desc("votes"), "how", "letters").collect()
    every = transformations()
    named = [every[r["how"]] for r in counted if r["how"] >= 0]
    named += [how * 2 for how in named if len(how) == 1 and how[0][1] == "utf_8" and how * 2 not in named]
    return LetterModel(*_letter_scores(pairs, number), tuple(named) + _learnt_map([(r["letters"], r["votes"]) for r in counted if r["how"] < 0]))


def _learnt_map(pairs: list[tuple[str, int]]) -> tuple[Transformation, ...]:
    """The map of the pairs of letters with these votes, none if too few letters agree."""
    total: Counter = Counter()
    for pair, n in pairs:
        total[pair[0]] += n
    letters = sorted(pair for pair, n in pairs if n >= 0.75 * total[pair[0]])
    return ((("map", "".join(letters)),),) if len(letters) >= MAP_LETTERS else ()


LETTERS_LOST = re.compile(LOST)
ADDRESS = re.compile(URL)


def lost(text: str) -> bool:
    """True where letters were lost to replacement characters or question marks (addresses don't count)."""
    return "\ufffd" in text or ("?" in text and LETTERS_LOST.search(ADDRESS.sub("", text)) is not None)


def restore(docs: DataFrame, doc: str, text: str, model: LetterModel) -> DataFrame:
    """Garbled documents: ``doc, restored, hits, lost``.

    ``restored`` is the text with every garbled token as it was written, ``hits`` the number of such tokens,
    ``lost`` whether letters are gone for good (they stay as they are). Null, empty and clean texts give no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            found = []
            for k, t in zip(pdf["doc"], pdf["t"]):
                gone = lost(t)
                new, hits = m.restore(t) if not t.isascii() and ODD.search(t) else (t, 0)
                if gone or hits:
                    found.append((k, new, hits, gone))
            out = pd.DataFrame(found, columns=["doc", "restored", "hits", "lost"])
            yield out.astype({"doc": pdf["doc"].dtype, "hits": "int32", "lost": "bool"})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"doc {kind}, restored string, hits int, lost boolean").withColumnRenamed("doc", doc)
