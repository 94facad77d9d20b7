"""Language identification: script ranges narrow a word's candidates, per-word scores feed a Viterbi search whose
switching penalty keeps spans of one language together, and the spans label mixed-language texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import hashed_sample, held_out, learnable, releasing, table, text_slices

WORD = re.compile(r"[^\W\d_]+")
#: Documents learned per language, about; the choice is by a hash of the id. They are counted in so many tasks.
LEARNED, TASKS = 1500, 6
#: Hash bins of each score table: letters, pairs, triples, words.
BINS = 1 << 16
TABLES = 4
#: What a change of language costs, in nats.
SWITCH = 12.0
#: What a language that does not use a word's script loses per word.
WRONG_SCRIPT = 30.0
#: A script belongs to a language if it has at least this share of the letters learned.
SCRIPT_SHARE = 0.02
#: Text code points searched together.
CHUNK = 2_000_000
#: Letters of distinct words scored at once.
SCORED = 200_000
UNKNOWN = "und"

# First code point of each script range; what is not listed counts as Latin or as its predecessor.
SCRIPT_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00,
                          0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0xA000, 0xAC00, 0xD800, 0x20000])
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "thai", "other", "georgian",
                "hangul", "other", "latin", "greek", "latin", "kana", "han", "hangul", "han", "other", "hangul", "other", "han")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])


class Numbered(dict):
    """Numbers words in the order they first appear."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def bins(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per letter of all words the bins of itself, the pair and the triple around it; where words start; word bins."""
    text = (" " + " ".join(words) + " ").lower()
    if len(text) != sum(map(len, words)) + len(words) + 1:  # lower-casing can add marks
        words = [w.lower() for w in words]
        text = " " + " ".join(words) + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = np.flatnonzero(c != 32)
    starts = np.flatnonzero(c[inner - 1] == 32)
    mix = np.uint64(0x9E3779B97F4A7C15)
    one, two = c[inner], c[inner - 1] * np.uint64(1 << 21) + c[inner]
    three = (two * mix) ^ (c[inner + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    # a word's hash: its letters weighted by powers that depend on their place in it
    place = np.arange(len(inner)) - np.repeat(starts, np.diff(np.r_[starts, len(inner)]))
    letters = (one + np.uint64(1)) * (mix ** ((place % 64).astype(np.uint64) + np.uint64(1)))
    whole = np.add.reduceat(letters, starts) if len(starts) else letters
    cut = lambda h: ((h * mix) >> np.uint64(48)).astype(np.int64)
    return cut(one), cut(two), cut(three), starts, cut(whole ^ (whole >> np.uint64(29)))


def scripts(words: list[str]) -> np.ndarray:
    """Script of each word, by its first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    return SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, first, side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  # TABLES x BINS x languages, log probabilities
    uses: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of each word by language, less the best one's; unusable scripts leave all equal."""
        out, start, size = np.empty((len(words), len(self.languages)), np.float32), 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= SCORED or i == len(words) - 1:
                out[start : i + 1] = self._scored(words[start : i + 1])
                start, size = i + 1, 0
        return out

    def _scored(self, words: list[str]) -> np.ndarray:
        a, b, c, starts, whole = bins(words)
        per_letter = self.tables[0][a] + self.tables[1][b] + self.tables[2][c]
        out = np.add.reduceat(per_letter, starts, axis=0) / 2 + self.tables[3][whole]
        out -= out.max(axis=1, keepdims=True)
        script = scripts(words)
        usable = self.uses[script]
        out = np.where(usable, out, -WRONG_SCRIPT)
        return np.where(usable.any(axis=1, keepdims=True), out, 0.0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; texts lie one after another in ``scores`` and are searched side by side."""
    n_langs = scores.shape[1]
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = start[order], lengths[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
    total = np.zeros((len(size), n_langs), np.float32)
    came = np.empty((len(scores), n_langs), np.uint8 if n_langs < 256 else np.int32)
    own = np.arange(n_langs)
    for t, n in enumerate(active):
        now = total[:n]
        at = begin[:n] + t
        if t:
            top = now.argmax(axis=1)
            fallback = now[np.arange(n), top] - switch
            stay = now >= fallback[:, None]
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, fallback[:, None])
        total[:n] = now + scores[at]
    path = np.empty(len(scores), np.int64)
    state = total.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return path


def _letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


def label_texts(model: Model, texts: list[str | None], spans: bool = True) -> list[tuple[str, float, list[tuple[str, int, int, int]]]]:
    """(language, its share of the letters, spans of (language, first word, last word, letters)) of each text."""
    found, lengths, number = [], np.zeros(len(texts), np.int64), Numbered()
    for i, t in enumerate(texts):
        words = WORD.findall(t) if t else []
        lengths[i] = len(words)
        found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    del found
    if not len(ids) or not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    distinct = list(number)
    letters = np.fromiter(map(_letters, distinct), np.int32, len(distinct))[ids]
    scores = model.word_scores(distinct)[ids]
    del distinct, number
    path = viterbi(scores, lengths)
    del scores
    out, at = [], 0
    for n in lengths:
        p, size = path[at : at + n], letters[at : at + n]
        at += n
        if not size.sum():
            out.append((UNKNOWN, 0.0, []))
            continue
        by_language = np.bincount(p, size, minlength=len(model.languages))
        cuts = np.r_[0, np.flatnonzero(np.diff(p)) + 1, n] if spans else np.zeros(0, np.int64)
        stretches = [(model.languages[p[a]], int(a), int(b) - 1, int(size[a:b].sum())) for a, b in zip(cuts[:-1], cuts[1:])]
        out.append((model.languages[int(by_language.argmax())], float(by_language.max() / size.sum()), stretches))
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of bins and scripts per language of this task's part of the sample."""
    held: dict[str, np.ndarray] = {}
    script: dict[str, Counter] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            words = WORD.findall(text)
            if not words:
                continue
            counts = held.setdefault(lang, np.zeros((TABLES, BINS), np.int64))
            *grams, _, whole = bins(words)
            for i, h in enumerate((*grams, whole)):
                counts[i] += np.bincount(h, minlength=BINS)
            got = np.bincount(scripts(words), [len(w) for w in words], minlength=len(SCRIPTS))
            script[lang] = script.get(lang, np.zeros(len(SCRIPTS))) + got
    for lang, counts in held.items():
        yield pd.DataFrame({"lang": [lang], "counts": [counts.astype(np.int32).tobytes()], "scripts": [script[lang].tobytes()]})


def learn(docs: DataFrame, per_language: int = LEARNED) -> Model:
    """A model from about ``per_language`` texts of each language of ``docs`` (doc_id, text, lang)."""
    usable = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    chosen = hashed_sample(usable.select("lang"), "doc_id", "lang", per_language)
    # a bounded sample in few tasks, so that few tables of counts come back
    sample = usable.filter(chosen & F.col("text").isNotNull()).select("lang", "text").repartition(TASKS)
    rows = sample.mapInPandas(releasing(_counted), "lang string, counts binary, scripts binary").collect()
    counts, script = {}, {}
    for r in rows:
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int32).reshape(TABLES, BINS).astype(np.int64)
        script[r["lang"]] = script.get(r["lang"], 0) + np.frombuffer(r["scripts"], np.float64)
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((TABLES, BINS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    stack = np.stack([counts[x] for x in languages], axis=-1).astype(np.float64) + 0.5
    tables = np.log(stack / stack.sum(axis=1, keepdims=True)).astype(np.float32)
    share = np.stack([script[x] / max(1.0, script[x].sum()) for x in languages], axis=-1)
    return Model(languages, tables, share >= SCRIPT_SHARE)


LABELS = "lang_pred string, score double"
SPANS = "spans array<struct<lang: string, first_word: int, last_word: int, letters: int>>"


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score and, if wanted, spans; columns of these three names are replaced.

    lang_pred is the language with the most letters, score their share, spans the stretches of words (runs of
    letters, counted from 0) in one language. Null texts and texts without a letter, and all texts under a model
    that has learned nothing, are ``und`` with score 0 and no span. Texts in scripts that no learned language uses
    get the first language in code point order.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLES x BINS numbers per language
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"{LABELS}, {SPANS}" if spans else LABELS).fields])
    arrow_spans = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, CHUNK):
                labels = label_texts(shared.value, texts, spans)
                del texts
                columns = [*part.columns, pa.array([x[0] for x in labels], pa.string()), pa.array([x[1] for x in labels], pa.float64())]
                if spans:
                    names = ("lang", "first_word", "last_word", "letters")
                    columns.append(pa.array([[dict(zip(names, s)) for s in x[2]] for x in labels], arrow_spans))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")), spans=False)
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
