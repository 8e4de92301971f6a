"""Freely typed place names mapped to the entries of a gazetteer.

A multi-pattern automaton over canonical names, transliterations and inflected forms finds the names embedded in
a value; the longest non-overlapping match wins, canonical names before inflected forms. What the automaton
leaves, or matches beside other words, goes to a token-set similarity: the tokens of the value and of a name are paired,
each equal in its sounds or one typing error away, and the share of letters that agree is the score; fewest errors win,
a score below ``AT_LEAST`` doesn't count. Where no name is alike, a single place mentioned beside other words counts.
Several entries of one name are told apart by the oblast that the value or its hint names, else the value stays
unmatched. ``report`` gives unmatched values with the entry most like them.

Scale. The gazetteer comes in parts of ``PART_ENTRIES`` entries at most, so no worker and no broadcast holds more of it at a
time, however long the list is. Each part's automaton and indexes say what they know about a value; what all parts
know is merged and decided at once, so the parts make no difference to the result. Values are matched row by
row behind a cache, so a place named in a third of all rows is matched once a worker and nothing is shuffled; only with
several parts the distinct values are, to bring the parts' answers together.
"""

from __future__ import annotations

import difflib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.functions.text import TRANSLITERATION
from terralens.io import ship_package
from terralens.llm.langid import plain

#: Entries of a part of the gazetteer; share of letters that must agree.
PART_ENTRIES, AT_LEAST = 20_000, 0.6
#: What a place is called by beside its name, in small letters.
KINDS = set("""
село с села селі місто м міста місті смт селище сел селища селищі н п пгт населений пункт населеному пункті громада громади хутір
город г городе города посёлок поселок пос посёлке деревня дер д деревне населённый пункт хутор
city town village settlement community hamlet of the near in at
біля поблизу неподалік під в у возле около близ під
""".split())
#: Words of roads, streets, directions, regions and vague areas, which name no entry.
VAGUE = set("""
траса траси трасі трасса трассы шосе шоссе дорога дороги дорозі автодорога highway road route motorway street avenue lane км кілометр километр km kilometre kilometer mile
вул вулиця вулиці ул улица улицы пров провулок просп проспект
напрямок напрямку напрям направление направлении sector direction axis front фронт фронту лінії линии line лінія
прикордонні прикордоння приграничные приграничье border районы районів районов райони districts district regions кілька несколько several областей областях
узлісся лісосмуга лесополоса промзона окраина околиця околиці берег березі берега bank river річки реки річка река вздовж вдоль уздовж along area areas залізниці железной
невідомо неизвестно unknown location невідоме невстановлене somewhere various різні разные
""".split())
#: Words beside a name that make a region, a direction or a stretch of it.
BESIDE = set("""
район району районі района районе область області области обл oblast region
північ півночі північніше південь півдні південніше захід заході західніше схід сході східніше між
север севере севернее юг юге южнее запад западе западнее восток востоке восточнее между
north south west east northern southern western eastern northeast northwest southeast southwest between
""".split())
REGION_WORDS = r"(?:область|області|обл\.?|області|области|oblast|region)"
#: Sounds of the Cyrillic letters in a common spelling of the languages at hand.
SOUNDS = dict(zip("абвгґдежзийклмнопрстуфхцчшыіїэ", "abvhhdežziiklmnoprstufxcčšiiie")) | {"щ": "šč", "ю": "iu", "я": "ia", "є": "ie", "ё": "e", "ь": "", "ъ": ""}
LATIN_SOUNDS = [("shch", "šč"), ("zh", "ž"), ("kh", "x"), ("ts", "c"), ("ch", "č"), ("sh", "š"), ("g", "h"), ("y", "i")]
#: The transliteration of Ukrainian names, and of Russian ones where it differs.
UK_LATIN = TRANSLITERATION
RU_LATIN = TRANSLITERATION | {"г": "g", "и": "i"}
#: Endings of place names and of adjectives, with those of their other cases.
UK_CASES = {
    "ське": "ському ського ським ськім", "цьке": "цькому цького цьким", "піль": "полі поля полю полем", "ичі": "ичах ичів ичам ичами", "ка": "ці ки ку кою", "ця": "ці цю цею", "ів": "ові ова ову овом ове",
    "їв": "єві єва єву", "е": "ому ого им ім", "є": "ьому ього ім", "а": "і и у ій ої ою", "я": "і ю ій ьої ьою", "ий": "ому ого им ім", "ій": "ьому ього ім", "і": "их им ими іх",
}
RU_CASES = {
    "ское": "ском ского скому ским", "поль": "поле поля полю полем", "ичи": "ичах ичей ичам ичами", "ка": "ке ки ку кой", "ца": "це цы цу цей", "ов": "ове ова ову овом", "ев": "еве ева еву евом",
    "ое": "ом ого ому ым", "ее": "ем его ему им", "ая": "ой ую", "яя": "ей юю", "ый": "ом ого ому ым", "ий": "ом ого ому им ем его", "ые": "ых ым ыми", "ие": "их им ими",
}


_APOSTROPHES, _SOUND_TABLE = str.maketrans("", "", "'’ʼ`"), str.maketrans(SOUNDS)
_DOUBLED = re.compile(r"(.)\1+")
_LATIN = re.compile("[a-z]")


@lru_cache(maxsize=200_000)
def sounds(text: str) -> str:
    """A spelling common to Ukrainian, Russian and their transliterations; doubled letters are single."""
    text = text.lower().translate(_APOSTROPHES)
    if _LATIN.search(text):
        for a, b in LATIN_SOUNDS:
            text = text.replace(a, b)
    return _DOUBLED.sub(r"\1", text.translate(_SOUND_TABLE))


def inflected(name: str, cases: dict[str, str]) -> set[str]:
    """``name`` (small letters) with all its words in another case."""

    def forms(word: str) -> list[str]:
        for end in sorted(cases, key=len, reverse=True):
            if word.endswith(end) and len(word) > len(end) + 1:
                return [word, *(word[: -len(end)] + x for x in cases[end].split())]
        return [word]

    out = {""}
    for word in name.split(" "):
        out = {f"{a} {b}".strip() for a in out for b in forms(word)}
    return out


def tidy(text: str) -> str:
    """Small letters, one form of each character and apostrophe, no quotes, single spaces."""
    text = re.sub(r"['’ʼ`´′]", "'", plain(text).lower())
    text = re.sub(r"[«»“”„\"]", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def one_edit(a: str, b: str) -> bool:
    """True if ``a`` becomes ``b`` by at most one letter more, less, other or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _deletes(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _within(word: str, index: dict[str, set[str]]) -> set[str]:
    """The words of a deletion index at most one edit from ``word``."""
    return {n for d in _deletes(word) for n in index.get(d, ()) if one_edit(word, n)}


def split_tokens(name: str) -> list[str]:
    """The tokens of ``name`` as spelt; hyphens part them."""
    return [t for t in re.split(r"[\s-]+", name) if t]


def token_set(name: str) -> tuple[str, ...]:
    """The sorted sounds of the tokens of ``name``."""
    return tuple(sorted(map(sounds, split_tokens(name))))


def _fewest(alike: list[dict[str, int]], other: tuple[str, ...]) -> int | None:
    """Fewest errors when each token, given by its ``alike`` ones, is paired with another of ``other``; null if they don't pair."""
    costs = {0: 0}
    for near in alike:
        then: dict[int, int] = {}
        for used, n in costs.items():
            for j, u in enumerate(other):
                if not used >> j & 1 and u in near:
                    then[used | 1 << j] = min(n + near[u], then.get(used | 1 << j, len(other)))
        costs = then
    return costs.get((1 << len(other)) - 1)


class Regions:
    """The oblasts' keys, and where a value names one."""

    def __init__(self, keys: list[str]):
        self.keys = {k: sounds(k) for k in sorted(keys)}
        self.region = lru_cache(maxsize=10_000)(self._region)

    def _region(self, text: str | None) -> str | None:
        """Key of the oblast that ``text`` names in any spelling, or null."""
        if not text or not self.keys:
            return None
        s = sounds(re.sub(rf"\b{REGION_WORDS}", " ", tidy(text)).strip(" .,()/"))
        s = re.sub(r"(?:s|z|c)?(?:ka|kaia|koi|koj|kii|koho|komu)$", "", s)
        if not s:
            return None
        ranked = sorted(((difflib.SequenceMatcher(None, s, re.sub("sk$", "", k)).ratio(), key) for key, k in self.keys.items()), reverse=True)
        return ranked[0][1] if ranked[0][0] >= 0.72 and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= 0.05) else None

    def split(self, text: str) -> tuple[str, str | None]:
        """The value without the oblast it names, and that oblast."""
        for pattern in (rf"[(\[]\s*([^()\[\]]+?)\s*[)\]]", r"\s/\s*([^/]+)$", rf",\s*([^,]*\b{REGION_WORDS})\s*$", rf"^([^,]*\b{REGION_WORDS})\s*,", rf"^(\S+\s+{REGION_WORDS})\s+", rf"\s(\S+\s+{REGION_WORDS})\s*$", rf"^(\S+\s+{REGION_WORDS})$", r",\s*([^,]+)$"):
            m = re.search(pattern, text)
            if m and (key := self.region(m[1])):
                return (text[: m.start()] + " " + text[m.end() :]).strip(" ,"), key
        return text, None

    def read(self, value: str | None, hint: str | None) -> tuple[str, str | None]:
        """The value tidied and without its oblast, and the oblast that it or its hint names."""
        text, key = self.split(tidy(value) if value else "")
        return text, key or self.region(hint)


def tokens_of(text: str) -> list[str]:
    """Words (with inner hyphens and apostrophes) and numbers of a tidied value."""
    return re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*|\d+", text)


def core_of(text: str) -> list[str]:
    """The tokens that may be a name: all but what a place is called."""
    tokens = tokens_of(text)
    return [t for t in tokens if t not in KINDS] or tokens


def token_set_ratio(a: list[str], b: list[str]) -> float:
    """Share of letters of ``a`` and ``b`` that agree when their tokens are paired: equal ones, then those one edit apart."""
    total = sum(map(len, a)) + sum(map(len, b))
    rest, agree = list(b), 0
    for test, errors in ((lambda x, y: x == y, 0), (lambda x, y: sounds(x) == sounds(y), 0), (one_edit, 2), (lambda x, y: one_edit(sounds(x), sounds(y)), 2)):
        for x in list(a):
            y = next((y for y in rest if test(x, y)), None)
            if y is not None:
                agree += len(x) + len(y) - errors
                rest.remove(y)
                a = [t for k, t in enumerate(a) if k != a.index(x)]
    return agree / total if total else 0.0


def decide(text: str, key: str | None, found: list[dict]) -> int:
    """Id of the entry that a value names, or 0, from what the parts of the gazetteer know about it (see ``Gazetteer.ask``)."""
    oblast = {i: o for f in found for i, o in f["oblast"]}

    def among(ids: set[int]) -> int:
        """The one entry of ``ids``, told by the oblast if there are several; 0 if it stays open."""
        here = [i for i in ids if oblast[i] == key] if key else []
        if here:
            return here[0] if len(here) == 1 else 0
        return next(iter(ids)) if len(ids) == 1 else 0

    spans: dict[tuple[int, int], dict[int, set[int]]] = {}
    for f in found:
        for start, end, kind, ids in f["mentions"]:
            spans.setdefault((start, end), {}).setdefault(kind, set()).update(ids)
    mentions: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(end <= a or start >= b for a, b in mentions):
            mentions.append((start, end))
    named = {frozenset(spans[m][min(spans[m])]) for m in mentions}
    left: list[str] = []
    if mentions:
        rest = text
        for start, end in sorted(mentions, reverse=True):
            rest = rest[:start] + " " + rest[end:]
        left = [t for t in re.findall(r"[^\W\d_]+|\d+", rest) if t not in KINDS]
        if not left:
            return among(set(*named)) if len(named) == 1 else 0
    tokens = tokens_of(text)
    if not tokens or any(t in VAGUE or t.isdigit() for t in tokens):
        return 0
    ranks = [(rank, ids) for f in found for rank, ids in f["alike"]]
    if ranks:
        least = min(rank for rank, _ in ranks)
        return among(set().union(*(ids for rank, ids in ranks if rank == least)))
    #: Other words beside the one place that is mentioned; places lying off it are vague, and words of other names make another.
    other = {t for f in found for t in f["parts"]} | BESIDE
    return among(set(*named)) if len(named) == 1 and not other.intersection(left) else 0


class Gazetteer:
    """The automaton, the spellings and the tokens of a gazetteer's entries ``(id, uk, ru, en, oblast)``."""

    def __init__(self, entries: list[tuple], oblasts: list[str] | None = None):
        self.oblast = {e[0]: e[4] for e in entries}
        self.regions = Regions(sorted({e[4] for e in entries if e[4]}) if oblasts is None else oblasts)
        base: dict[str, set[int]] = defaultdict(set)
        cases: dict[str, set[int]] = defaultdict(set)
        for i, uk, ru, en, _ in entries:
            uk, ru, en = (tidy(x) if x else "" for x in (uk, ru, en))
            names = {uk, ru, en, "".join(UK_LATIN.get(c, c) for c in uk), "".join(RU_LATIN.get(c, c) for c in ru)} - {""}
            for n in names:
                base[n].add(i)
            for n in inflected(uk, UK_CASES) | inflected(ru, RU_CASES):
                if n and n not in names:
                    cases[n].add(i)
        self.base, self.cases = dict(base), dict(cases)
        self.automaton = ahocorasick.Automaton()
        for name in self.cases.keys() | self.base.keys():
            self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.spelt: dict[str, set[int]] = defaultdict(set)
        self.near: dict[str, set[str]] = defaultdict(set)
        self.near_sound: dict[str, set[str]] = defaultdict(set)
        #: Entries of each token set, in sounds and as spelt; the sets of each token as spelt; tokens by sound; tokens and their sounds by deletions.
        self.sets: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.spelt_sets: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.sets_of: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        self.tokens_of: dict[str, set[str]] = defaultdict(set)
        self.near_token: dict[str, set[str]] = defaultdict(set)
        self.near_said: dict[str, set[str]] = defaultdict(set)
        for name, ids in self.base.items():
            self.spelt[sounds(name)] |= ids
            self.sets[token_set(name)] |= ids
            self.spelt_sets[tuple(sorted(split_tokens(name)))] |= ids
            for d in _deletes(name):
                self.near[d].add(name)
        for said in self.spelt:
            for d in _deletes(said):
                self.near_sound[d].add(said)
        for tokens in self.spelt_sets:
            for t in tokens:
                self.sets_of[t].add(tokens)
        for t in self.sets_of:
            self.tokens_of[sounds(t)].add(t)
            for d in _deletes(t):
                self.near_token[d].add(t)
        for said in self.tokens_of:
            for d in _deletes(said):
                self.near_said[d].add(said)
        #: No longer value (letters, tokens) is within the allowed edits of a name.
        self.longest = 1 + max(map(len, self.base.keys() | self.spelt.keys()), default=0)
        self.most_tokens = max(map(len, self.spelt_sets), default=0)
        self.spelt_cases: dict[str, set[int]] = defaultdict(set)
        self.sets_cases: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for name, ids in self.cases.items():
            self.spelt_cases[sounds(name)] |= ids
            self.sets_cases[token_set(name)] |= ids
        #: Sounds of the words that make names of several words; beside a name they make it another.
        self.parts = {t for tokens in self.sets.keys() | self.sets_cases.keys() if len(tokens) > 1 for t in tokens}
        self.match = lru_cache(maxsize=200_000)(self._match)

    def _embedded(self, text: str) -> list[tuple[int, int, int, list[int]]]:
        """All names on word boundaries: ``(start, end, kind, ids)``, kind 0 as listed, 1 inflected."""
        if not len(self.automaton):
            return []
        edge = lambda i: i < 0 or i >= len(text) or not (text[i].isalnum() or text[i] in "'-")
        found = [(end - len(name) + 1, end + 1, name) for end, name in self.automaton.iter(text) if edge(end - len(name)) and edge(end + 1)]
        return [(s, e, kind, sorted(names[name])) for s, e, name in found for kind, names in enumerate((self.base, self.cases)) if name in names]

    def ask(self, text: str, alone: bool = True) -> dict:
        """What this gazetteer knows about a tidied value: ``mentions``, names ``alike`` by rank, words that are ``parts`` of names, ``oblast`` of all these entries.

        Parts matter only beside a mention, which without ``alone`` another gazetteer may find.
        """
        mentions = self._embedded(text)
        whole = any(not [t for t in tokens_of(text[:s] + " " + text[e:]) if t not in KINDS] for s, e, _, _ in mentions)
        alike = [] if whole or any(t in VAGUE or t.isdigit() for t in tokens_of(text)) else self._alike(core_of(text))
        ids = {i for *_, own in mentions for i in own} | {i for _, own in alike for i in own}
        parts: list[str] = []
        if not (whole or alike) and (mentions or not alone):
            inside = bytearray(len(text))
            for s, e, _, _ in mentions if alone else []:
                inside[s:e] = b"\1" * (e - s)
            parts = [m[0] for m in re.finditer(r"[^\W\d_]+", text) if not inside[m.start()] and self._is_part(m[0])]
        return {"mentions": mentions, "alike": alike, "parts": parts, "oblast": [(i, self.oblast[i]) for i in sorted(ids)]}

    def _match(self, value: str | None, hint: str | None) -> int:
        """Id of the entry that ``value`` names, or 0."""
        text, key = self.regions.read(value, hint)
        return decide(text, key, [self.ask(text)])

    def closest(self, value: str | None) -> tuple[int, float] | None:
        """The entry whose name is most like ``value`` by ``token_set_ratio``, however little; null if no token is near any."""
        core = core_of(self.regions.read(value, None)[0])
        sets = {s for t in core for u in self._near_tokens(t) for s in self.sets_of[u]}
        best = min(((-token_set_ratio(core, list(s)), min(self.spelt_sets[s])) for s in sets), default=None)
        return best and (best[1], -best[0])

    def _is_part(self, token: str) -> bool:
        """True for a word, up to an error, of the names of several words."""
        return sounds(token) in self.parts or any(len(s) > 1 for u in self._near_tokens(token) for s in self.sets_of[u])

    def _alike(self, tokens: list[str]) -> list[tuple[int, list[int]]]:
        """Entries whose names are like ``tokens``: ``(rank, ids)``, equal sounds first, then equal token sets, then by errors."""
        name, said, kinds = " ".join(tokens), sounds(" ".join(tokens)), tuple(sorted(sounds(t) for x in tokens for t in split_tokens(x)))
        out = [(rank, ids) for rank, ids in enumerate((self.spelt.get(said), self.spelt_cases.get(said), self.sets.get(kinds), self.sets_cases.get(kinds))) if ids][:1]
        if not out and (near := _within(name, self.near) if len(name) <= self.longest else set()):
            out = [(4, set().union(*(self.base[n] for n in near)))]
        if not out:
            #: Fewest errors win: one in the sounds of the whole name, or in as few tokens as possible.
            out = [(5, self.spelt[n]) for n in (_within(said, self.near_sound) if len(said) <= self.longest else ())]
            spelt = [t for x in tokens for t in split_tokens(x)]
            out += [(4 + n, self.spelt_sets[other]) for other, n in self._near_sets(spelt) if token_set_ratio(spelt, list(other)) >= AT_LEAST]
        return [(rank, sorted(ids)) for rank, ids in out]

    def _near_tokens(self, token: str) -> dict[str, int]:
        """The names' tokens at most one edit from ``token``, spelt or in sounds; 0 for equal sounds, else 1."""
        said = sounds(token)
        near = _within(token, self.near_token) if len(token) <= self.longest else set()
        alike = _within(said, self.near_said) if len(said) <= self.longest else set()
        return dict.fromkeys(near.union(*(self.tokens_of[s] for s in alike)), 1) | dict.fromkeys(self.tokens_of.get(said, ()), 0)

    def _near_sets(self, tokens: list[str]) -> list[tuple[tuple[str, ...], int]]:
        """The names' token sets equal to ``tokens`` up to one error a token, with the number of tokens that have one."""
        if not 0 < len(tokens) <= self.most_tokens:
            return []
        alike = [self._near_tokens(t) for t in tokens]
        sets = set.intersection(*({s for u in near for s in self.sets_of[u] if len(s) == len(tokens)} for near in alike))
        return [(s, n) for s in sets if (n := _fewest(alike, s)) is not None]


_built: dict[tuple, Gazetteer] = {}


def _parts(gazetteer: DataFrame, part_entries: int) -> tuple[list, list[str]]:
    """The gazetteer's parts, each broadcast by itself, and the keys of all oblasts."""
    entries = gazetteer.select("id", "name_uk", "name_ru", "name_en", "oblast").distinct()
    sc = gazetteer.sparkSession.sparkContext
    parts = max(1, math.ceil(entries.count() / part_entries * 1.1))
    of = F.pmod(F.xxhash64("id"), F.lit(parts))
    oblasts = sorted(r[0] for r in entries.where("oblast IS NOT NULL").select("oblast").distinct().collect())
    return [sc.broadcast(sorted((tuple(r) for r in entries.where(of == p).collect()), key=lambda r: (r[0] is None, r[0]))) for p in range(parts)], oblasts


def _gazetteer(shared, number: int, oblasts: list[str]) -> Gazetteer:
    """The part's indexes, built once in a worker."""
    if number not in _built:
        _built.clear()
        _built[number] = Gazetteer(shared.value, oblasts)
    return _built[number]


def _number(shared) -> int:
    return shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)


def _texts(column: pd.Series) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in column]


def match_places(values: DataFrame, keep: tuple[str, ...], name: str, hint: str, gazetteer: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """``keep`` plus ``gazetteer_id``: the entry each value names, 0 if none or not to be told.

    ``gazetteer`` has ``id, name_uk, name_ru, name_en, oblast``. Null and blank values get 0. Names of ``keep``
    must not clash with ``gazetteer_id``.
    """
    ship_package(values.sparkSession)
    parts, oblasts = _parts(gazetteer, part_entries)
    values = values.select(*keep, F.col(name).alias("_v"), F.col(hint).alias("_h"))
    if len(parts) == 1:
        shared, number = parts[0], _number(parts[0])
        fields = values.select(*keep).schema.fields
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["gazetteer_id bigint"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            match = _gazetteer(shared, number, oblasts).match
            for pdf in batches:
                yield pdf[list(keep)].assign(gazetteer_id=[match(v, h) for v, h in zip(_texts(pdf["_v"]), _texts(pdf["_h"]))])

        return values.mapInPandas(run, schema)
    asked = values.select("_v", "_h").distinct()

    def of_part(shared, number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = _gazetteer(shared, number, oblasts)
            for pdf in batches:
                yield pdf[["_v", "_h"]].assign(known=[json.dumps(part.ask(part.regions.read(v, h)[0], alone=False)) for v, h in zip(_texts(pdf["_v"]), _texts(pdf["_h"]))])

        return asked.mapInPandas(run, "_v string, _h string, known string")

    known = of_part(parts[0], _number(parts[0]))
    for shared in parts[1:]:
        known = known.unionByName(of_part(shared, _number(shared)))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        regions = Regions(oblasts)
        for pdf in batches:
            ids = [decide(*regions.read(v, h), [json.loads(k) for k in found]) for v, h, found in zip(_texts(pdf["_v"]), _texts(pdf["_h"]), pdf["known"])]
            yield pd.DataFrame({"_v2": pdf["_v"], "_h2": pdf["_h"], "gazetteer_id": ids})

    settled = known.groupBy("_v", "_h").agg(F.collect_list("known").alias("known")).mapInPandas(settle, "_v2 string, _h2 string, gazetteer_id bigint")
    return values.join(settled, F.col("_v").eqNullSafe(F.col("_v2")) & F.col("_h").eqNullSafe(F.col("_h2"))).select(*keep, "gazetteer_id")


def report(values: DataFrame, name: str, hint: str, gazetteer: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Unmatched values: ``value, hint, n, closest, score``, how often each occurs and the entry whose name is most like it.

    ``score`` is the ``token_set_ratio``; both are null where no token is near any of a name. Of entries as like the
    smallest id.
    """
    counts = values.select(F.col(name).alias("value"), F.col(hint).alias("hint")).groupBy("value", "hint").agg(F.count(F.lit(1)).alias("n"))
    open_ = match_places(counts, ("value", "hint", "n"), "value", "hint", gazetteer, part_entries).where("gazetteer_id = 0").drop("gazetteer_id")
    parts, oblasts = _parts(gazetteer, part_entries)

    def of_part(shared, number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = _gazetteer(shared, number, oblasts)
            for pdf in batches:
                best = [part.closest(v) or (None, None) for v in _texts(pdf["value"])]
                yield pdf.assign(closest=pd.array([b[0] for b in best], dtype="Int64"), score=pd.array([b[1] for b in best], dtype="Float64"))

        return open_.mapInPandas(run, "value string, hint string, n bigint, closest bigint, score double")

    all_ = of_part(parts[0], _number(parts[0]))
    for shared in parts[1:]:
        all_ = all_.unionByName(of_part(shared, _number(shared)))
    best = F.min(F.when(F.col("closest").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("closest").alias("c")))).alias("b")
    return all_.groupBy("value", "hint", "n").agg(best).select("value", "hint", "n", F.col("b.c").alias("closest"), F.round(-F.col("b.s"), 4).alias("score"))
