"""Language of each document and of each segment in another language.

Script ranges narrow a word's candidates to the languages written in its script; word scores, learnt here from a
bounded sample of labelled rows, weigh them; Viterbi with a switching penalty (high inside a sentence, low between
sentences) labels the words, and runs of sentences of one label become segments with a confidence. Words of a sentence
are no independent witnesses, so the scores are tempered for the confidence by a factor fitted on held-out fragments.

The word scores are one table on every executor, the words of ``FIT_ROWS`` rows; each row is labelled by itself, so
nothing is shuffled. Viterbi runs over a batch of texts at once, one numpy step per word position.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.llm import visual

LANGUAGES = ("uk", "ru", "en", "de", "pl")
#: ISO 639 codes and English names.
NAMES = {
    "uk": "uk", "ukr": "uk", "ukrainian": "uk", "ru": "ru", "rus": "ru", "russian": "ru", "en": "en", "eng": "en", "english": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "pl": "pl", "pol": "pl", "polish": "pl",
}
#: The model is fitted on so many rows with a known label, chosen by the hash of their id.
FIT_ROWS, MIN_DOCS = 6000, 3
IN_SENTENCE, BETWEEN = 8.0, 1.5
#: Padded word positions that one Viterbi pass may hold.
CELLS = 400_000
WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?…])[\s\"»”’)]+|\n+")
#: Score of a language that is not written in a word's script: beyond what two switches cost.
MASKED = -20.0
#: Quoted words don't count; a quotation stays within a line.
QUOTED = re.compile(r"«[^«»\n]+»|[„“][^„“”\"\n]+[”“\"]|\"[^\"\n]+\"")
#: Tempering factors that are tried, and the words of a fragment they are tried on.
TEMPERS, FRAGMENT = (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.3), 3
CYRILLIC, LATIN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[a-zß-ſ]")
#: Letters that only one of the languages writes, by position in LANGUAGES.
LETTERS = ("іїєґ", "ыэъё", "", "äöüß", "ąęłśźżćń")
_USUAL = frozenset(re.findall(f"[{visual.PLAIN}]", "".join(map(chr, range(0x2200))))) | {"\n", "\t"}
MIXED = re.compile(f"{visual.LATIN}{visual.CYRILLIC}|{visual.CYRILLIC}{visual.LATIN}|[Ͱ-Ͽ]")
_TWINS = {(a, s): b for a, s, b in visual.lookalikes()}


def _script(c: str) -> str:
    return "C" if "\u0400" <= c <= "\u052f" else "G" if "\u0370" <= c <= "\u03ff" else "L"


def _one_script(m: re.Match) -> str:
    """A word of several scripts with its look-alikes turned to the script of its other letters."""
    w = m[0]
    scripts = [_script(c) for c in w]
    if len(set(scripts)) == 1:
        return w
    #: Letters without a twin decide; then the number of letters.
    there = set(scripts)
    weight = {s: sum((1 if any((c, t) in _TWINS for t in there) else 100) for c, x in zip(w, scripts) if x == s) for s in "CLG"}
    s = max(weight, key=weight.get)
    return "".join(_TWINS.get((c, s), c) for c in w)


def plain(text: str) -> str:
    """``text`` with full-width and joined forms, invisible characters and look-alikes of another script undone."""
    odd = [c for c in set(text) - _USUAL if unicodedata.category(c)[0] in "LMCN"]
    if odd:
        text = unicodedata.normalize("NFKC", text.translate({ord(c): None for c in odd if unicodedata.category(c) == "Cf"}))
    return WORD.sub(_one_script, text) if MIXED.search(text) else text


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence, without quotations; sentences without a word are left out."""
    if not text:
        return []
    return [w for s in SENTENCE.split(QUOTED.sub(" ", plain(text)).lower()) if (w := WORD.findall(s))]


@dataclass(frozen=True)
class WordModel:
    """Log probabilities of each language for each word; unknown words are judged by their letters."""

    index: dict[str, int]
    scores: np.ndarray
    temper: float = 1.0

    def row(self, word: str) -> int:
        """Row of a word's scores; of an unknown one by the languages' own letters, else by script (rows 0 to 7)."""
        return self.index.get(word) or self.unknown(word)

    def unknown(self, word: str) -> int:
        for i, own in enumerate(LETTERS):
            if any(c in own for c in word):
                return 3 + i
        return 1 if CYRILLIC.search(word) else 2 if LATIN.search(word) else 0


def _written(word: str) -> np.ndarray:
    """True for the languages written in the word's script; for all if it has letters of neither or of both."""
    c, x = bool(CYRILLIC.search(word)), bool(LATIN.search(word))
    return np.array([c or not x] * 2 + [x or not c] * 3)


def _rows_for_unknown() -> np.ndarray:
    rows = np.zeros((8, len(LANGUAGES)))
    rows[1, 2:] = MASKED
    rows[2, :2] = MASKED
    for i in range(len(LANGUAGES)):
        rows[3 + i] = -2.0
        rows[3 + i, ~_written("\u0430" if i < 2 else "a")] = MASKED
        rows[3 + i, i] = 0.0
    return rows


def _fit(counts: list[Counter]) -> WordModel:
    docs = Counter()
    for c in counts:
        docs.update(c)
    words = sorted(w for w, k in docs.items() if k >= MIN_DOCS)
    totals = [sum(c.values()) + 1000 for c in counts]
    rows = [_rows_for_unknown()]
    if words:
        p = np.array([[(c[w] + 0.1) / t for c, t in zip(counts, totals)] for w in words])
        written = np.array([_written(w) for w in words])
        p = np.where(written, p, 0.0)
        with np.errstate(divide="ignore"):
            rows.append(np.where(written, np.maximum(np.log(p / p.sum(axis=1, keepdims=True)), -6.0), MASKED))
    return WordModel({w: i + 8 for i, w in enumerate(words)}, np.vstack(rows))


def _softmax(total: np.ndarray) -> np.ndarray:
    e = np.exp(total - total.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fragments(model: WordModel, sents: list[list[str]], size: int = FRAGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Summed scores of the first ``size`` words of each longer sentence, and its language by all its words but these."""
    total, lang = [], []
    for s in sents:
        if len(s) >= 2 * size + 2:
            v = model.scores[[model.row(w) for w in s]]
            total.append(v[:size].sum(axis=0))
            lang.append(int(np.argmax(v[size:].sum(axis=0))))
    return np.array(total).reshape(-1, len(LANGUAGES)), np.array(lang, dtype=int)


def fitted_temper(model: WordModel, sents: list[list[str]]) -> float:
    """The factor under which the fragments' scores make their sentences' languages most likely; 1 without sentences."""
    total, lang = fragments(model, sents)
    if not len(lang):
        return 1.0
    return max(TEMPERS, key=lambda t: np.log(np.maximum(_softmax(total * t)[np.arange(len(lang)), lang], 1e-12)).mean())


def language_of_label(label: str | None) -> str | None:
    """The language that a label names, or null: a code of two or three letters with or without country, or an English name, in any case."""
    return NAMES.get(re.split(r"[-_]", label.strip().lower())[0]) if label else None


def label_column(label: Column) -> Column:
    """``language_of_label`` as a column."""
    code = F.split(F.lower(F.trim(label)), "[-_]")[0]
    return F.coalesce(*[F.when(code.isin([k for k, v in NAMES.items() if v == lang]), lang) for lang in LANGUAGES])


def fit_word_model(docs: DataFrame, doc: str, texts: tuple[str, ...], label: str, fit_rows: int = FIT_ROWS) -> WordModel:
    """Word scores from ``fit_rows`` rows with a known label, the ones whose hashed ids are smallest.

    Labels are noisy, so after a first count the sample's sentences are labelled by the model itself and
    counted again. The confidence's tempering is fitted on the sentences of every other row by a model of the rest. Only
    the sample comes to the driver.
    """
    known = docs.where(label_column(F.col(label)).isNotNull())
    h = F.xxhash64(F.col(doc))
    bound = known.select(h.alias("h")).orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    rows = known.where(h <= bound).select(*texts, label).limit(2 * fit_rows).collect() if bound is not None else []
    items = [(language_of_label(r[-1]), [s for t in r[:-1] for s in sentences(t)]) for r in rows]
    counts = [Counter() for _ in LANGUAGES]
    for lang, sents in items:
        counts[LANGUAGES.index(lang)].update({w for s in sents for w in s})
    model = _fit(counts)
    halves = [[Counter() for _ in LANGUAGES] for _ in range(2)]
    for k, (_, sents) in enumerate(items):
        for s in sents:
            v = sum(model.scores[model.row(w)] for w in s)
            halves[k % 2][int(np.argmax(v))].update(set(s))
    temper = fitted_temper(_fit(halves[0]), [s for _, sents in items[1::2] for s in sents])
    final = _fit([a + b for a, b in zip(*halves)])
    return WordModel(final.index, final.scores, temper)


def viterbi(ids: list[np.ndarray], starts: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
    """Best label of each word of each text; ``starts`` are true where a sentence begins."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(ids)
    order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: len(ids[k]))
    n = scores.shape[1]
    at = 0
    while at < len(order):
        #: Texts of like length together; the longest of a pass is its last.
        end = at + 1
        while end < len(order) and len(ids[order[end]]) * (end + 1 - at) <= CELLS:
            end += 1
        group = order[at:end]
        at = end
        lengths = np.array([len(ids[k]) for k in group])
        steps, b = int(lengths[-1]), len(group)
        word = np.zeros((steps, b), dtype=np.int64)
        cost = np.full((steps, b), 1e9)
        for j, k in enumerate(group):
            word[: lengths[j], j] = ids[k]
            cost[: lengths[j], j] = np.where(starts[k], BETWEEN, IN_SENTENCE)
        v = scores[word[0]]
        back = np.zeros((steps, b, n), dtype=np.int8)
        same = np.arange(n, dtype=np.int8)
        for t in range(1, steps):
            best = v.argmax(axis=1)
            jump = v[np.arange(b), best] - cost[t]
            stay = v >= jump[:, None]
            back[t] = np.where(stay, same, best[:, None])
            v = np.where(stay, v, jump[:, None]) + np.where(t < lengths, 1.0, 0.0)[:, None] * scores[word[t]]
        lab = np.zeros((steps, b), dtype=np.int8)
        cur = v.argmax(axis=1)
        rows = np.arange(b)
        for t in range(steps - 1, -1, -1):
            lab[t] = cur
            if t:
                cur = back[t, rows, cur]
        for j, k in enumerate(group):
            out[k] = lab[: lengths[j], j]
    return out


SEGMENTS = "parts array<int>, firsts array<int>, lasts array<int>, langs array<string>, confs array<double>, sizes array<int>"


def _segment_batch(texts: list[list[str | None]], model: WordModel) -> dict[str, list]:
    """Segments of each row of ``texts``; part k is the k-th text, sentences are numbered from 0 within it."""
    get, unknown = model.index.get, model.unknown
    ids, starts, part_of = [], [], []
    for row in texts:
        flat, first, parts = [], [], []
        for part, text in enumerate(row):
            for s in sentences(text):
                first.append(len(flat))
                parts.append(part)
                flat += [get(w) or unknown(w) for w in s]
        begin = np.zeros(len(flat), dtype=bool)
        begin[first] = True
        ids.append(np.array(flat, dtype=np.int64))
        starts.append(begin)
        part_of.append(parts)
    labels = viterbi(ids, starts, model.scores)
    out: dict[str, list] = {k: [] for k in ("parts", "firsts", "lasts", "langs", "confs", "sizes")}
    n = len(LANGUAGES)
    for word, begin, parts, lab in zip(ids, starts, part_of, labels):
        row: dict[str, list] = {k: [] for k in out}
        if len(word):
            at = np.flatnonzero(begin)
            size = np.diff(np.append(at, len(word)))
            votes = np.add.reduceat((lab[:, None] == np.arange(n)).astype(np.int32), at, axis=0)
            lang = votes.argmax(axis=1)
            score = np.add.reduceat(model.scores[word], at, axis=0)
            parts = np.array(parts)
            new = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (parts[1:] != parts[:-1])))
            last = np.append(new[1:], len(lang)) - 1
            total = np.add.reduceat(score, new, axis=0)
            conf = _softmax(total * model.temper)[np.arange(len(new)), lang[new]]
            offset = np.searchsorted(parts, parts[new])
            row = {
                "parts": parts[new].tolist(), "firsts": (new - offset).tolist(), "lasts": (last - offset).tolist(),
                "langs": [LANGUAGES[i] for i in lang[new]], "confs": np.round(conf, 4).tolist(), "sizes": np.add.reduceat(size, new).tolist(),
            }
        for k, v in row.items():
            out[k].append(v)
    return out


def label_languages(docs: DataFrame, keep: tuple[str, ...], texts: tuple[str, ...], model: WordModel) -> DataFrame:
    """``keep`` plus arrays that describe the segments of the rows' ``texts`` in order.

    A segment is a run of sentences of one language within one text (``parts``: which, from 0; ``firsts`` and
    ``lasts``: its sentences, from 0), with ``langs``, ``confs`` (tempered posterior of the language over the segment's
    words) and ``sizes`` in words. Null, empty and wordless texts have no segment. Names of ``keep`` that clash
    with the result's are the caller's to rename.
    """
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SEGMENTS])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[t if isinstance(t, str) else None for t in r] for r in zip(*[pdf[c] for c in texts])]
            yield pdf[list(keep)].assign(**_segment_batch(rows, shared.value))

    return docs.select(*dict.fromkeys([*keep, *texts])).mapInPandas(run, schema)


def segments(labelled: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per segment of ``label_languages``: ``keep, part, first, last, lang, confidence, words``."""
    s = labelled.select(*keep, F.explode(F.arrays_zip("parts", "firsts", "lasts", "langs", "confs", "sizes")).alias("s"))
    return s.select(*keep, F.col("s.parts").alias("part"), F.col("s.firsts").alias("first"), F.col("s.lasts").alias("last"), F.col("s.langs").alias("lang"), F.col("s.confs").alias("confidence"), F.col("s.sizes").alias("words"))


def mislabelled(labelled: DataFrame, doc: str, label: str) -> DataFrame:
    """``doc, lang``: rows of ``label_languages`` in more than one language or in another than the label names."""
    langs = F.array_distinct("langs")
    wrong = (F.size(langs) > 1) | ~F.element_at(langs, 1).eqNullSafe(label_column(F.col(label)))
    return labelled.where(F.size("langs") > 0).where(wrong).select(doc, F.explode(langs).alias("lang"))
