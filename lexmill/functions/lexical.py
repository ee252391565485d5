"""Tokens, stems and stop words as column expressions.  No Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of retrieval.
RETRIEVAL_STOP = tuple(
    """
    a about above after again against all also am an and any are aren't as at be because been before being below
    between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each
    few for from further had hadn't has hasn't have haven't having he her here hers herself him himself his how
    i if in into is isn't it its itself just let's me more most mustn't my myself no nor not of off on once only
    or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the
    their theirs them themselves then there these they this those through to too under until up very was wasn't
    we were weren't what when where which while who whom why will with won't would wouldn't you your yours
    yourself yourselves please tell say said explain describe give show mean means meant whats
    """.split()
)
#: The stop words of grading, query building and video ranking.
CONTENT_STOP = tuple(
    """
    a an the and or but so if then of to in on at by for from with about into as is are was were be been am do does did
    not no it its this that these those they them their there here what which who how why when where can could would
    should will just also very more most some any than too i me my we you your he she his her our us
    """.split()
)
#: Suffixes in the order in which they are tried, and what a raw token is.
SUFFIXES = ("ingly", "edly", "ing", "ed", "ly", "es")
RAW_TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_AS_RE2 = {r"\b": _EDGE, r"\s": r"[\t\n\f\r ]", "k": r"[k\x{212A}]", "s": r"[s\x{17F}]"}


def as_re2(pattern: str) -> str:
    """A case-insensitive pattern of lower-case literals so that Java reads it as RE2 does: words
    end where ASCII letters do, white space has no vertical tab, and k and s have a third case."""
    return re.sub(r"\\.|[ks]", lambda m: _AS_RE2.get(m[0], m[0]), pattern)


def stem(word: Column) -> Column:
    """A light English stem: the first rule that applies, in this order."""
    n = F.length(word)

    def less(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    out = F.when((n <= 3) | word.rlike("^[0-9]+$"), word).when(word.endswith("sses"), less(2)).when(word.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y")))
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (n - len(s) >= 3), less(len(s)))
    bare = word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is")
    return out.when(bare, less(1)).otherwise(word)


def tokens(text: Column) -> Column:
    """Retrieval tokens of a text, in order, repeats included."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(RAW_TOKEN), F.lit(0))

    def kept(r: Column) -> Column:
        word = F.substring_index(r, "'", 1)
        return ~word.isin(*RETRIEVAL_STOP) & ~r.isin(*RETRIEVAL_STOP) & ((F.length(word) > 1) | word.rlike("^[0-9]$"))

    return F.transform(F.filter(raw, kept), lambda r: stem(F.substring_index(r, "'", 1)))


def content_stems(text: Column) -> Column:
    """Stems of the content words, in order, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*CONTENT_STOP) & ((F.length(w) > 1) | w.rlike("[0-9]"))), stem)


def round_half_up(x: Column) -> Column:
    """Rounding to an integer with halves toward plus infinity."""
    return F.floor(x + 0.5)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, zero norms counting as one, clipped to [0, 1]."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(x: Column) -> Column:
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, 1.0).otherwise(n)

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))
