"""All of a document's analysis from one pass over its chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from . import graph, importance, keywords, structure


@dataclass
class Analysis:
    """Lazy tables of an analysis; chunks and ranked sentences are written once and shared."""

    chunks: DataFrame
    ranked: DataFrame
    keywords: DataFrame
    summary: DataFrame
    sentence_importance: DataFrame
    chunk_importance: DataFrame
    embeddings: DataFrame
    embedding_model: str
    warnings: list[str] = field(default_factory=list)


def analyze(docs: DataFrame, embedder=None, model: str | None = None) -> Analysis:
    """Chunks, embeddings, merged keywords, summary and importance of ``docs`` (doc_id, text).

    A document without a sentence has no chunk and no other row.  Without an ``embedder`` the
    vectors are TF-IDF ones, and a warning says so.
    """
    chunked = staged(structure.document_chunks(docs, headed=True), "chunks")
    ranked = staged(graph.rank_sentences(structure.document_index(chunked)), "sentences")
    texts = chunked.select("doc_id", F.transform("chunks", lambda c: c["text"]).alias("texts"))
    whole = texts.select("doc_id", F.array_join("texts", "\n\n").alias("text"))
    found = {"tfidf": keywords.tfidf_keywords(texts), "rake": keywords.rake_keywords(whole), "yake": keywords.ngram_keywords(whole)}
    vectors, name, warnings = keywords.embed(texts, embedder, model)
    rows = importance.sentence_importance(ranked)
    return Analysis(
        chunked.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*"), ranked, keywords.merge_keywords(found), graph.summary(ranked), rows, importance.chunk_importance(rows), vectors, name, warnings
    )
