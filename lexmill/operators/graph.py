"""TextRank over the sentences of each document, and extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from .keywords import words
from .weights import Weights, documents, joined, weigh

DAMPING, LEAST_SIMILARITY, ROUNDS = 0.85, 0.05, 30
#: Cells of the similarity matrix that are filled at a time.
_CELLS = 1 << 21


def similarities(w: Weights, least: float = LEAST_SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim), a < b: cosines of at least ``least``, row block by row block.

    Only products of entries that share a term are formed.
    """
    order = np.argsort(w.term, kind="stable")
    by_term, term_first = w.part[order], np.searchsorted(w.term[order], np.arange(len(w.vocabulary) + 1))
    height = min(w.parts, max(1, _CELLS // max(w.parts, 1)))
    found = []
    for low in range(0, w.parts, height):
        i = np.arange(*np.searchsorted(w.part, (low, low + height)))
        n = term_first[w.term[i] + 1] - term_first[w.term[i]]
        other = order[np.repeat(term_first[w.term[i]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        cell = np.repeat(w.part[i] - low, n) * w.parts + w.part[other]
        sims = np.round(np.bincount(cell, np.repeat(w.weight[i], n) * w.weight[other], height * w.parts), 9)
        cells = np.flatnonzero(sims >= least)
        a, b = cells // w.parts + low, cells % w.parts
        found.append((a[a < b], b[a < b], sims[cells][a < b]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (by_term, by_term, w.weight)


def ranks(w: Weights, damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """A fixed number of power iterations, the mass of sentences without links spread evenly; best 1.

    A document of one sentence scores 1; one without any term is uniform.
    """
    n = w.parts
    a, b, sim = similarities(w)
    src, dst, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
    out = np.bincount(src, sim, n)
    score, idle = np.full(n, 1 / n), out == 0
    share = sim / out[src]
    for _ in range(rounds):
        score = (1 - damping) / n + damping * (np.bincount(dst, score[src] * share, n) + score[idle].sum() / n)
    return score if n > 1 and not len(w.part) else score / score.max()


def rank_sentences(indexed: DataFrame) -> DataFrame:
    """(doc_id, sentences) with ``score`` and ``mean`` in each sentence: its TextRank and the mean
    weight of its terms (null without any).  ``sentences`` are structs with a ``text``.

    The graph of a document is built and iterated beside its sentences: a narrow transformation.
    """
    kind = indexed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, out = None, []
        for now, _, texts in documents(batches, "texts"):
            if batch is not None and now is not batch:
                yield shown(batch, out)
                out = []
            batch = now
            if not texts:
                out.append([])
                continue
            w = weigh(texts, False, None)
            n = np.bincount(w.part, minlength=w.parts)
            means = np.bincount(w.part, w.weight, w.parts) / np.maximum(n, 1)
            out.append([{"score": s, "mean": m if k else None} for s, m, k in zip(ranks(w).tolist(), means.tolist(), n.tolist())])
        if batch is not None:
            yield shown(batch, out)

    def shown(batch: pa.RecordBatch, out: list[list[dict]]) -> pa.RecordBatch:
        told = pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("mean", pa.float64())])))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), told], ["doc_id", "sentences", "r"])

    told = indexed.select("doc_id", "sentences", F.transform("sentences", lambda s: joined(words(s["text"]))).alias("texts"))
    shape = indexed.schema["sentences"].dataType.simpleString()
    ranked = told.mapInArrow(run, f"doc_id {kind}, sentences {shape}, r array<struct<score:double,mean:double>>")
    names = indexed.schema["sentences"].dataType.elementType.fieldNames()
    both = F.zip_with("sentences", "r", lambda s, r: F.struct(*[s[n].alias(n) for n in names], r["score"].alias("score"), r["mean"].alias("mean")))
    return ranked.select("doc_id", both.alias("sentences"))


def textrank(sentences: DataFrame) -> DataFrame:
    """(doc_id, position, score) of ``sentences`` (doc_id, position, text): those of a document are
    brought together once."""
    indexed = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("sentences"))
    return rank_sentences(indexed).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.position", "s.score")


def summary(ranked: DataFrame, n: int = SETTINGS.summary_sentences) -> DataFrame:
    """(doc_id, position, text, score) of ``rank_sentences``: the n best sentences of each document."""
    order = F.transform("sentences", lambda s: F.struct((-F.round(s["score"], 9)).alias("o"), s["position"].alias("position"), s["text"].alias("text"), s["score"].alias("score")))
    top = ranked.select("doc_id", F.explode(F.slice(F.array_sort(order), 1, n)).alias("s"))
    return top.select("doc_id", "s.position", "s.text", F.round("s.score", 4).alias("score"))
