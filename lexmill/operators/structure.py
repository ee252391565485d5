"""Headings, sentences, token counts, chunks and the sentence index of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SETTINGS
from .cleaning import strip

#: What headings, bullets and tokens look like.
NUMBERED = r"^(\d+(\.\d+){0,3})[.)]?\s+\S"
ALL_CAPS = r"^[A-Z0-9][A-Z0-9\s\-:,&/()]{2,80}$"
TITLE_CASE = r"^([A-Z][a-zA-Z0-9'&]*\s*){1,10}$"
BULLET = r"^\s*[-*•]\s+"
#: Words that open a heading.
HEADING_WORDS = ("introduction", "conclusion", "summary", "abstract", "background", "overview", "references", "appendix", "methodology", "results", "discussion", "objectives", "chapter", "section")
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "fig", "eq", "no", "vol", "pp", "op", "ca", "cf", "al", "inc", "ltd", "co", "a.m", "p.m", "u.s", "u.k", "u.n", "approx", "dept", "univ", "gov")
TOKEN = r"(?U)\w+(?:['’]\w+)*|[^\w\s]"
#: Stand-ins while sentences are cut: a period that ends nothing, a boundary.
_DOT, _CUT = "\u001f", "\u001e"


def paragraphs(text: Column) -> Column:
    """Stripped lines that hold something, in order."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def heading_level(line: Column) -> Column:
    """Level of a stripped line by its text alone; 0 if it is no heading."""
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    first = F.regexp_replace(F.lower(F.element_at(F.split(line, r"\s+"), 1)), "^:+|:+$", "")
    common = first.isin(*HEADING_WORDS)
    dots = F.length(F.regexp_extract(line, NUMBERED, 1)) - F.length(F.replace(F.regexp_extract(line, NUMBERED, 1), F.lit("."), F.lit("")))
    short = (words <= 8) & ~line.rlike(r"[.!?,;]\s*$") & (line.rlike(r"^\p{Lu}") | common)
    return (
        F.when((line == "") | line.rlike(BULLET) | (F.length(line) > 90), 0)
        .when(line.rlike(NUMBERED), F.least(dots + 1, F.lit(4)))
        .when(line.rlike(ALL_CAPS) & (words <= 12) & line.rlike(r"\p{L}"), 1)
        .when(short & common, 1)
        .when(short & line.rlike(TITLE_CASE), 2)
        .otherwise(0)
        .cast("long")
    )


def headings(docs: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_index, text, level, char_offset) of ``docs`` (doc_id, text).

    ``fonts`` (doc_id, line, size) lifts lines set larger than their document's median size:
    1.4 times and up to 15 words is level 1, 1.15 times is level 2 unless already a heading.
    """
    lines = docs.select("doc_id", F.col("text").alias("_doc"), F.posexplode(paragraphs(F.col("text"))).alias("line_index", "text"))
    level = heading_level(F.col("text"))
    if fonts is not None:
        one = fonts.groupBy("doc_id", strip(F.col("line")).alias("text")).agg(F.max("size").alias("size"))
        median = one.groupBy("doc_id").agg(F.median("size").alias("median"))
        lines = lines.join(one, ["doc_id", "text"], "left").join(median, "doc_id", "left")
        words = F.size(F.split("text", r"\s+"))
        big = F.coalesce((F.col("size") >= 1.4 * F.col("median")) & (words <= 15), F.lit(False))
        larger = F.coalesce(F.col("size") >= 1.15 * F.col("median"), F.lit(False))
        level = F.when(big, F.lit(1)).when(larger & (level == 0), F.lit(2)).otherwise(level).cast("long")
    found = lines.select("doc_id", F.col("line_index").cast("long").alias("line_index"), "text", level.alias("level"), (F.instr("_doc", F.col("text")) - 1).cast("long").alias("char_offset"))
    return found.where("level > 0")


def sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph, by replacement of boundaries with a sentinel.

    Periods of abbreviations, and all that follow a digit, are masked first.  The patterns begin
    with the period and look back from there, so only periods are tried.
    """
    text = strip(paragraph)
    dotted = text
    for a in sorted((a for a in ABBREVIATIONS if "." in a), key=lambda a: (-len(a), a)):
        head, tail = a.split(".")
        dotted = F.regexp_replace(dotted, rf"(?iU)\b({head})\.({tail})\.", f"$1{_DOT}$2{_DOT}")
    text = F.when(text.rlike(r"\.\S\."), dotted).otherwise(text)
    plain = "|".join(sorted((a for a in ABBREVIATIONS if "." not in a), key=lambda a: (-len(a), a)))
    text = F.regexp_replace(text, rf"(?iU)\.(?<=\b(?:{plain})\.|[0-9]\.)", _DOT)
    text = F.regexp_replace(text, r"([.!?][\"')\]]?)\s+(?=[A-Z0-9\"'(\[])", f"$1{_CUT}")
    parts = F.transform(F.split(text, _CUT), lambda x: strip(F.translate(x, _DOT, ".")))
    return F.filter(parts, lambda x: x != "")


def count_tokens(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.regexp_count(text, F.lit(TOKEN.removeprefix("(?U)")))).otherwise(F.regexp_count(text, F.lit(TOKEN)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def chunk_ranges(counts: pd.Series, target: pd.Series, overlap: pd.Series) -> pd.Series:
    """Sentence ranges of the chunks of each document, from token counts alone.

    Each start depends on the last end, so the ranges are found one by one, each by two binary
    searches in the running sums; no text leaves the JVM.
    """

    def ranges(n: np.ndarray, most: int, shared: int) -> list[dict]:
        upto = np.concatenate([[0], np.cumsum(n)])
        out, first, size = [], 0, len(n)
        while first < size:
            end = max(first + 1, int(np.searchsorted(upto, upto[first] + most, "right")) - 1)
            out.append({"first": first, "last": end - 1})
            back = int(np.searchsorted(upto, upto[end] - shared, "left"))
            first = size if end == size else back if back > first else end
        return out

    return pd.Series([ranges(np.asarray([] if c is None else c, np.int64), int(t), int(o)) for c, t, o in zip(counts, target, overlap)])


#: So marked only to keep the planner from copying the call into the generator below it.
chunk_ranges = chunk_ranges.asNondeterministic()


def document_sentences(docs: DataFrame, *carried: Column) -> DataFrame:
    """(doc_id, carried, s): the sentences of a document in order with their line and token count."""
    per_line = F.transform(
        paragraphs(F.col("text")),
        lambda p, i: F.transform(sentences(p), lambda x: F.struct(x.alias("text"), i.cast("long").alias("line"), count_tokens(x).alias("n"))),
    )
    return docs.select("doc_id", *carried, F.flatten(per_line).alias("s"))


def unnested(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(doc_id, the fields of each element of ``column``).  A plain ``explode`` makes the planner filter
    by the size of the array first, which computes the array once more, in a form that grows with
    its square where elements look at their neighbours."""
    out = rows.select("doc_id", F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())
    return out.select("doc_id", f"{name}.*")


def own_headings(text: Column) -> Column:
    """The headings of a text by its own lines: an array of (line_index, text)."""
    lines = F.transform(paragraphs(text), lambda x, i: F.struct(i.cast("long").alias("line_index"), x.alias("text")))
    return F.filter(lines, lambda x: heading_level(x["text"]) > 0)


def document_chunks(docs: DataFrame, headed: bool = False, target: int = SETTINGS.chunk_tokens, overlap: int = SETTINGS.overlap_tokens) -> DataFrame:
    """(doc_id, chunks: array of chunk_id, position, text, token_count, first_line, heading), one
    row per document with a sentence; a narrow transformation.

    With ``headed`` each chunk takes the last of the document's own headings at or before its
    first line.
    """
    heads = own_headings(F.col("text")) if headed else F.array().cast("array<struct<line_index:bigint,text:string>>")
    told = document_sentences(docs, heads.alias("h"))
    # Documents without a sentence go by their ranges: a filter on ``s`` would split all texts once more.
    cut = told.withColumn("r", chunk_ranges(F.transform("s", lambda x: x["n"]), F.lit(target), F.lit(overlap))).where(F.size("r") > 0)

    def chunk(r: Column, i: Column) -> Column:
        own = F.slice("s", r["first"] + 1, r["last"] - r["first"] + 1)
        line = F.get("s", r["first"])["line"]
        before = F.filter("h", lambda h: h["line_index"] <= line)
        # Sentences meet at a blank, so no token spans two: a chunk has the sum of their tokens.
        return F.struct(
            F.concat(F.lit("c"), i).alias("chunk_id"), i.cast("long").alias("position"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"),
            F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("token_count"), line.alias("first_line"), F.coalesce(F.get(before, F.size(before) - 1)["text"], F.lit("")).alias("heading"),
        )

    return cut.select("doc_id", F.transform("r", chunk).alias("chunks"))


def chunks(docs: DataFrame, heads: DataFrame | None = None, headed: bool = False, target: int = SETTINGS.chunk_tokens, overlap: int = SETTINGS.overlap_tokens) -> DataFrame:
    """(doc_id, chunk_id, position, text, token_count, first_line, heading).

    ``headed`` takes headings from the documents themselves, without a join; ``heads`` from a
    table, by an as-of lookup.
    """
    out = unnested(document_chunks(docs, headed, target, overlap), "chunks", "c")
    return out if heads is None else nearest_heading(out.drop("heading"), heads)


def nearest_heading(chunk_rows: DataFrame, heads: DataFrame) -> DataFrame:
    """As-of lookup: a document's few headings travel to its chunks as one sorted array."""
    lists = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("_h"))
    before = F.filter("_h", lambda h: h["line_index"] <= F.col("first_line"))
    found = F.when(F.size(before) > 0, F.element_at(before, -1)["text"])
    return chunk_rows.join(lists, "doc_id", "left").withColumn("heading", F.coalesce(found, F.lit(""))).drop("_h")


def document_index(chunked: DataFrame) -> DataFrame:
    """(doc_id, sentences: array of position, text, chunk_id, heading, sentence_index_in_chunk) of
    ``document_chunks``: the sentences of the chunks without those that the previous chunk holds
    as well, numbered through a document.  A narrow transformation."""
    split = chunked.select("doc_id", "chunks", F.transform("chunks", lambda c: sentences(c["text"])).alias("own"))

    def kept(c: Column, k: Column) -> Column:
        before = F.get("own", k - 1)
        told = F.transform(F.get("own", k), lambda x, i: F.struct(x.alias("text"), c["chunk_id"].alias("chunk_id"), c["heading"].alias("heading"), i.cast("long").alias("sentence_index_in_chunk")))
        return F.when(k == 0, told).otherwise(F.filter(told, lambda x: ~F.array_contains(before, x["text"])))

    flat = split.select("doc_id", F.flatten(F.transform("chunks", kept)).alias("x"))
    numbered = F.transform("x", lambda x, i: F.struct(i.cast("long").alias("position"), x["text"].alias("text"), x["chunk_id"].alias("chunk_id"), x["heading"].alias("heading"), x["sentence_index_in_chunk"].alias("sentence_index_in_chunk")))
    return flat.select("doc_id", numbered.alias("sentences"))


def sentence_index(chunk_rows: DataFrame) -> DataFrame:
    """(doc_id, position, text, chunk_id, heading, sentence_index_in_chunk) of chunk rows: those of
    a document are brought together once."""
    one = F.struct("position", "chunk_id", "text", "heading")
    chunked = chunk_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    return unnested(document_index(chunked), "sentences", "s")


def ingest_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, cleaned_chars, ocr_confidence, needs_llm_ocr) of (doc_id, cleaned_text, ocr_confidence)."""
    chars = F.length(strip(F.col("cleaned_text"))).cast("long")
    poor = (chars < SETTINGS.min_total_chars) | F.coalesce(F.col("ocr_confidence") < SETTINGS.ocr_min_confidence, F.lit(False))
    return docs.select("doc_id", chars.alias("cleaned_chars"), "ocr_confidence", poor.alias("needs_llm_ocr"))
