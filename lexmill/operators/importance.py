"""Importance of sentences and chunks: six features, each rounded before it is weighed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from .cleaning import strip

#: Phrases that define, and what counts as a number.
DEFINES = r"(?i)\b(is defined as|refers to|is called|are called|means|is known as|can be defined as)\b"
NUMERIC = r"(?i)(\d+([.,]\d+)?%?|\b\d{4}\b|[=+\-*/^]|\b\d+\s*(kg|km|cm|mm|ms|mg|ml|g|m|s|hz|kb|mb|gb)\b)"
FEATURES = ("tfidf", "heading", "definition", "numeric", "position", "textrank")


def places(x: Column, n: int = 4) -> Column:
    """Round as decimals: weighed 4-place values often end in an exact half."""
    return F.round(x.cast("decimal(18,9)"), n).cast("double")


def position_score(position: Column, n: Column) -> Column:
    """Linear ramps over the first and the last 15 % of a document."""
    share = position / (n - 1)
    ramps = F.greatest(F.greatest(F.lit(0.0), 1 - share / 0.15), F.greatest(F.lit(0.0), 1 - (1 - share) / 0.15))
    return F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), ramps))


def numeric_score(text: Column) -> Column:
    hits = F.regexp_count(text, F.lit(NUMERIC))
    return F.when(hits == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 + 0.2 * hits))


def sentence_importance(ranked: DataFrame) -> DataFrame:
    """(doc_id, position, chunk_id, features..., score) of ``graph.rank_sentences``; narrow."""
    top = F.array_max(F.transform("sentences", lambda s: F.coalesce(s["mean"], F.lit(0.0))))
    full = ranked.select("doc_id", top.alias("_top"), F.size("sentences").alias("_n"), F.explode("sentences").alias("s"))
    text = F.col("s.text")
    feats = {
        "tfidf": places(F.coalesce("s.mean", F.lit(0.0)) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)),
        "heading": F.when(strip(F.col("s.heading")) != "", 1.0).otherwise(0.0),
        "definition": F.when(text.rlike(DEFINES), 1.0).otherwise(0.0),
        "numeric": numeric_score(text),
        "position": places(position_score(F.col("s.position"), F.col("_n"))),
        "textrank": places(F.col("s.score")),
    }
    shown = full.select("doc_id", "s.position", "s.chunk_id", *[c.alias(f"f_{k}") for k, c in feats.items()])
    total = reduce(Column.__add__, [F.col(f"f_{k}") * SETTINGS.importance_weights[k] for k in FEATURES])
    return shown.withColumn("score", places(total))


def chunk_importance(rows: DataFrame) -> DataFrame:
    """Means of the rounded sentence values; chunks left without a sentence have no row."""
    return rows.groupBy("doc_id", "chunk_id").agg(*[places(F.avg(c)).alias(c) for c in ("score", *[f"f_{k}" for k in FEATURES])])
