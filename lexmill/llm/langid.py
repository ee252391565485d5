"""Language identification with labelled spans.

The script of a word (ranges of code points) narrows the languages it may belong to.  Among
these each word is scored by character trigrams with word edges; a Viterbi pass over the
words, in which every change of language costs a fixed penalty, labels the spans of a text.
The language of a text is the one whose spans hold most of its letters.

Training counts trigrams, scripts and words of every labelled text it is given; they are
summed in each task before they move, so the result has at most ``BUCKETS`` rows a language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import Mapper, map_texts

#: First code points of script ranges, and the scripts.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200,
                 0x1E00, 0x1F00, 0x2000, 0x2C80, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0x10000)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "other", "thai", "other", "georgian", "hangul", "ethiopic",
           "latin", "greek", "other", "other", "hiragana", "katakana", "other", "hangul", "other", "han", "other", "hangul", "other", "han", "latin", "arabic", "other", "arabic", "other", "other")
_NAMES = tuple(sorted(set(SCRIPTS)))
_SCRIPT_OF_RANGE = np.array([_NAMES.index(s) for s in SCRIPTS])

BITS = 18
BUCKETS = 1 << BITS
#: Code points handled at once.
_BLOCK = 1 << 19
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points, of all planes, are letters; and which are letters or marks."""
    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    return kinds == ord("L"), (kinds == ord("L")) | (kinds == ord("M"))


@dataclass
class Words:
    """The words of a block of texts: trigram buckets of their letters and where words begin."""

    buckets: np.ndarray  # of each letter
    starts: np.ndarray  # of each word, in buckets
    sizes: np.ndarray  # letters of each word
    texts: np.ndarray  # row of each word
    scripts: np.ndarray  # of each word's first letter


def words_of(texts: list[str]) -> Words:
    letters, parts = _letters()
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
    letter = parts[codes]
    at = np.flatnonzero(letter)
    own = letters[codes[at]]
    if not own.all():  # marks without any letter beside them are no words
        word = np.cumsum(np.append(True, np.diff(at) > 1)) - 1
        at = at[(np.bincount(word, own) > 0)[word]]
    if not len(at):
        none = np.empty(0, np.int64)
        return Words(none, none, none, none, none)
    shown = np.where(letter, codes, 0).astype(np.uint32)  # a word's edge is code 0
    before = np.where(at > 0, shown[at - 1], 0).astype(np.uint32)
    after = shown[np.minimum(at + 1, len(shown) - 1)]
    mixed = (before * _M1 ^ shown[at]) * _M2
    mixed = ((mixed >> np.uint32(15)) ^ mixed ^ after * _M1) * _M3
    first = np.flatnonzero(before == 0)
    ends = np.cumsum([len(t) + 1 for t in low])
    heads = at[first]
    ranges = np.searchsorted(SCRIPT_STARTS, codes[heads], "right") - 1
    return Words((mixed >> np.uint32(32 - BITS)).astype(np.int64), first, np.diff(np.append(first, len(at))), np.searchsorted(ends, heads, "right"), _SCRIPT_OF_RANGE[ranges])


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    rows, size, held = [], 0, []
    for i, t in enumerate(texts):
        if rows and size + len(t or "") > _BLOCK:
            yield rows, held
            rows, size, held = [], 0, []
        rows.append(i)
        held.append(t or "")
        size += len(t or "") + 1
    if rows:
        yield rows, held


class LanguageModel:
    """Log-probabilities of trigram buckets by language, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, str, int, int]], penalty: float = 12.0, script_share: float = 0.001):
        """counts: (lang, "gram" or "script", bucket or script number, count)."""
        self.languages = sorted({c[0] for c in counts})
        n = len(self.languages)
        grams, scripts = np.zeros((BUCKETS, n), np.float32), np.zeros((len(_NAMES), n))
        for lang, kind, key, count in counts:
            (grams if kind == "gram" else scripts)[key, self.languages.index(lang)] += count
        grams += 0.05
        self.scores = np.log(grams / grams.sum(0)).astype(np.float32) if n else grams
        allowed = scripts >= script_share * np.maximum(scripts.sum(0), 1)
        self.known = allowed.any(1)  # scripts that some language uses
        allowed |= ~allowed.any(1, keepdims=True)  # a script of no language rules none out
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)
        self.penalty = penalty

    def spans(self, texts: list[str]) -> tuple[np.ndarray, Words]:
        """The language number of each word, by Viterbi, for a block of texts."""
        w = words_of(texts)
        if not len(w.starts) or not self.languages:
            return np.empty(0, np.int64), w
        score = np.add.reduceat(self.scores[w.buckets], w.starts, axis=0) + self.barred[w.scripts]
        return self._viterbi(score, w.texts), w

    def _viterbi(self, score: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """All texts of the block step together, longest first, so each step is one array operation."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        length = np.diff(np.append(first, len(owner)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with over t words
        best = score[first].astype(np.float64)
        back = np.empty(score.shape, np.int8 if score.shape[1] < 128 else np.int32)
        own = np.arange(score.shape[1])
        for t in range(1, length[0]):
            k = active[t]
            prev = best[:k]
            top = prev.argmax(1)
            moved = prev[np.arange(k), top][:, None] - self.penalty
            stay = prev >= moved
            at = first[:k] + t
            back[at] = np.where(stay, own, top[:, None])
            best[:k] = np.where(stay, prev, moved) + score[at]
        labels = np.empty(len(owner), np.int64)
        now = best.argmax(1)
        for t in range(length[0] - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            labels[at] = now[:k]
            if t:
                now[:k] = back[at, now[:k]]
        return labels

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """(language, share of the letters in its spans, number of spans, share of the letters in
        scripts that some language uses); ``und`` without letters."""
        out: list[tuple[str, float, int, float]] = [("und", 0.0, 0, 0.0)] * len(texts)
        for rows, held in _blocks(texts):
            labels, w = self.spans(held)
            if not len(labels):
                continue
            n = len(self.languages)
            mass = np.bincount(w.texts * n + labels, w.sizes, len(held) * n).reshape(-1, n)
            changes = (np.diff(w.texts, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0)
            spans = np.bincount(w.texts[changes], minlength=len(held))
            known = np.bincount(w.texts, w.sizes * self.known[w.scripts], len(held))
            for i in np.flatnonzero(mass.sum(1)).tolist():
                k = int(mass[i].argmax())
                out[rows[i]] = (self.languages[k], float(mass[i, k] / mass[i].sum()), int(spans[i]), float(known[i] / mass[i].sum()))
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = 12.0) -> LanguageModel:
    """Counts over every row with a text and a language; ties and repeated rows count as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, held in _blocks(texts):
                w = words_of(held)
                if not len(w.starts):
                    continue
                of_word = np.array([langs[r] for r in rows], object)[w.texts]
                of_letter = np.repeat(of_word, w.sizes)
                for lang in {langs[r] for r in rows}:
                    grams[lang] = grams.get(lang, 0) + np.bincount(w.buckets[of_letter == lang], minlength=BUCKETS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(w.scripts[of_word == lang], minlength=len(_NAMES))
        for kind, tables in (("gram", grams), ("script", scripts)):
            for lang, counts in tables.items():
                key = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([kind] * len(key), pa.string()), pa.array(key, pa.int32()), pa.array(counts[key], pa.int64())], ["lang", "kind", "key", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, kind string, key int, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return LanguageModel([tuple(r) for r in counts.collect()], penalty)  # at most BUCKETS + scripts rows a language


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_spans), one row per input row.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if
    nothing was learned.  Ties go to the language that sorts first.  Repeated rows repeat
    their result; an empty table gives an empty one; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    def setup() -> Mapper:
        def mapper(texts: list[str | None]) -> tuple[None, list]:
            found = shared.value.predict(texts)
            return None, [[f[i] for f in found] for i in range(3)]

        return mapper

    return map_texts(df, id_col, text_col, setup, "lang_pred string, score double, n_spans long")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.3, least_known: float = 0.5) -> DataFrame:
    """The rows whose language is told, all columns as they are: it holds at least ``least`` of
    the letters, and at least ``least_known`` of them are of scripts that some language uses.

    Null texts and texts without a letter go, as does every text if nothing was learned.
    Repeated rows are judged alike; ties go to the language that sorts first.  An empty table
    stays empty; columns may have any names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            good = [lang != "und" and score >= least and known >= least_known for lang, score, _, known in found]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds
