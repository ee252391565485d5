"""Benchmark decontamination by q-gram lemma filtering.

A benchmark passage of m characters that stands in a document with at most e edits shares
at least m - q + 1 - q*e of its q-grams with it, all on at most e + 1 neighbouring diagonals
(place in the document minus place in the passage).  So q-gram hits are counted in bands of
diagonals, twice as wide as they are apart, that hold any such neighbourhood whole; bands that
reach the bound are kept and verified by a banded alignment.  Nothing else is lost or kept.

Every passage has its own q, the longest up to Q that keeps the bound at one or more, and its
own bands, wide enough for its edits: no length is treated otherwise than by these formulas.

Texts are compared in lower case with runs of white space as one space, by code points.  A
passage of under LEAST characters is no evidence of a leak and matches nothing; one too short
to afford an edit must stand between characters other than letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import Mapper, columns_of, map_texts

Q, ERROR_RATE, BAND, LEAST = 10, 0.08, 32, 8
#: Characters of documents hashed at once, and of benchmark passages indexed at once.
_DOC_BLOCK, ITEM_BLOCK = 1 << 20, 4_000_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_MASK = (1 << 64) - 1


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, by doubling: log2(q) vector steps."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    power, width, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if q & width:
            part = power[: len(codes) - width + 1]
            if out is None:
                out, done = part, width
            else:
                n = len(codes) - done - width + 1
                out, done = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[done : done + n], done + width
        if width * 2 > q:
            return out[: len(codes) - q + 1]
        power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2


def banded_edits(piece: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int]:
    """(least edits, end in text) of ``piece`` against text that begins on a diagonal from
    ``low`` on; (most + 1, -1) if there is none within ``most`` edits."""
    sentinel = np.uint32(0xFFFFFFFF)
    padded = np.full(width + len(piece), sentinel, np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    inside = (np.arange(width) + low >= 0) & (np.arange(width) + low <= len(text))
    row, steps = np.where(inside, 0, most + 1).astype(np.int32), np.arange(width, dtype=np.int32)
    for i, c in enumerate(piece):
        best = row + (padded[i : i + width] != c)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > most:
            return most + 1, -1
    at = int(row.argmin())
    return int(row[at]), at + low + len(piece)


class PassageIndex:
    """Postings of the q-grams of a bounded block of benchmark passages, for each q in use."""

    def __init__(self, items: list[tuple], q: int = Q, error_rate: float = ERROR_RATE, least: int = LEAST):
        self.items, self.parts = [], []
        bound, edits, band, grams = [], [], [], {}
        for item, text in items:
            plain = normal(text)
            if (m := len(plain)) < least:
                continue
            e = int(error_rate * m)
            own = min(q, m // (e + 1))
            codes = _codes(plain)
            grams.setdefault(own, []).append((len(self.items), qgram_hashes(codes, own)))
            self.items.append(item)
            self.parts.append((codes, plain))
            bound.append(m - own + 1 - own * e)
            edits.append(e)
            band.append(max(BAND, e + 1))
        self.bound, self.edits, self.band = (np.array(x, np.int64) for x in (bound, edits, band))
        self.tables = {own: _Postings(rows) for own, rows in sorted(grams.items())}

    def search(self, texts: list[str | None]) -> list[tuple]:
        """(row, item, edits, start, end): the best place of each passage found in each text."""
        out, at = [], 0
        plain = [normal(t) for t in texts]
        while at < len(plain):
            to, size = at, 0
            while to < len(plain) and (size == 0 or size + len(plain[to]) < _DOC_BLOCK):
                size, to = size + len(plain[to]) + 1, to + 1
            out += [(at + r, *x) for r, *x in self._block(plain[at:to])]
            at = to
        return out

    def _block(self, plain: list[str]) -> list[tuple]:
        best: dict[tuple, tuple[int, int, int]] = {}
        codes = _codes("\0".join(plain))
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in plain])])
        for own, table in self.tables.items():
            for r, part, low in self._bands(table.hits(qgram_hashes(codes, own)), starts):
                self._verify(best, plain[r], codes[starts[r] : starts[r] + len(plain[r])], r, part, low)
        return [(r, item, *found) for (r, item), found in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]

    def _bands(self, hits: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, passage, first diagonal) of the bands that hold as many hits as the lemma demands."""
        at, owner, place = hits
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        band = (at - starts[doc] - place) // self.band[owner]
        lowest, parts = int(band.min()) - 1, len(self.parts)
        span = int(band.max()) - lowest + 1
        key = (doc * parts + owner) * span + band - lowest
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # a hit counts in both bands over it
        for k in keys[counts >= self.bound[keys // span % parts]].tolist():
            part = k // span % parts
            yield k // span // parts, part, (k % span + lowest) * int(self.band[part])

    def _verify(self, best: dict, text: str, codes: np.ndarray, r: int, part: int, low: int) -> None:
        item, (piece, plain), e, wide = self.items[part], self.parts[part], int(self.edits[part]), int(self.band[part])
        if (r, item) in best and best[r, item][0] == 0:
            return
        begin = low - e
        i = text.find(plain, max(0, begin), low + 2 * wide + e + len(plain))
        while i >= 0:  # the alignment without an edit
            if e or not ((i and text[i - 1].isalnum()) or text[i + len(plain) : i + len(plain) + 1].isalnum()):
                best[r, item] = (0, i, i + len(plain))
                return
            i = text.find(plain, i + 1, low + 2 * wide + e + len(plain))
        if not e:
            return
        edits, end = banded_edits(piece, codes, begin, 2 * wide + 2 * e + 1, e)
        if edits <= e and edits < best.get((r, item), (e + 1,))[0]:
            best[r, item] = (edits, max(0, end - len(plain)), end)


class _Postings:
    """Where each q-gram stands in which passage."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        every = np.concatenate([h for _, h in rows])
        order = np.argsort(every, kind="stable")
        self.owner = np.concatenate([np.full(len(h), k, np.int64) for k, h in rows])[order]
        self.place = np.concatenate([np.arange(len(h), dtype=np.int64) for _, h in rows])[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of all equal q-grams."""
        at = np.flatnonzero(self.maybe[self._slot(hashes)])
        i = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        true = self.keys[i] == hashes[at]
        at, i = at[true], i[true]
        n = self.count[i]
        posting = np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[posting], self.place[posting]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in hash blocks of about ITEM_BLOCK characters; one for small tables."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    n = -(-total // ITEM_BLOCK)
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, error_rate: float = ERROR_RATE, least: int = LEAST
) -> DataFrame:
    """(id, item_id, edits, start, end): one row per document row and passage found.

    Places count code points of the normalised text.  Null texts, and passages that are null or
    of under ``least`` characters, match nothing; a passage repeated in the benchmark is found
    under each id; repeated documents repeat their rows.  Empty tables give an empty result.
    Only the two columns are read.  The benchmark is a stated query set: it is dealt into blocks
    of bounded size, each of which meets all documents.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"{item_col} must be a long, an int or a string, not {kind}")
    context, found = df.sparkSession.sparkContext, []
    for block in _blocks(benchmark, item_col, item_text):
        shared = context.broadcast([tuple(r) for r in block.collect()])  # at most about ITEM_BLOCK characters

        def setup(shared=shared) -> Mapper:
            index = PassageIndex(shared.value, q, error_rate, least)

            def mapper(texts: list[str | None]) -> tuple[list[int], list]:
                rows = index.search(texts)
                return [r[0] for r in rows], columns_of([r[1:] for r in rows], 4)

            return mapper

        found.append(map_texts(df, id_col, text_col, setup, f"item_id {kind}, edits long, start long, end long"))
    if not found:  # an empty benchmark
        kinds = {"item_id": kind, "edits": "long", "start": "long", "end": "long"}
        return df.where("false").select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    return reduce(DataFrame.unionByName, found)


def without_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, error_rate: float = ERROR_RATE, least: int = LEAST
) -> DataFrame:
    """The rows of ``df`` that hold no benchmark passage, all columns as they are; no shuffle.

    Null and empty texts stay, as does every row if the benchmark has no passage of ``least``
    characters; repeated rows stay or go together.  An empty table stays empty; columns may have
    any names.
    """
    context = df.sparkSession.sparkContext
    for block in _blocks(benchmark, item_col, item_text):
        shared = context.broadcast([tuple(r) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, q, error_rate, least)
            for batch in batches:
                bad = {r[0] for r in index.search(batch.column(batch.schema.get_field_index(text_col)).to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
