"""Text cleaning as column expressions and one aggregate-and-probe transform."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic marks and what replaces them.
MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "﻿": ""}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBER = r"(?i)^\s*(\d{1,4}|[ivxlcdm]{1,6}|page\s+\d{1,4}(\s*(of|/)\s*\d{1,4})?|\d{1,4}\s*(of|/)\s*\d{1,4})\s*$"
ENDS_CLAUSE = r"[.!?:;\"')\]]\s*$"
OPENS_ITEM = r"^(\s*[-*•]|\s*\d+[.)]\s|\s*[A-Z][A-Z\s]{3,}$)"
CAPS_LINE = r"^\s*[A-Z][A-Z0-9\s:&,-]{3,}$"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; the one step that has no JVM function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def plain_marks(text: Column) -> Column:
    kept = "".join(k for k, v in MARKS.items() if v)
    gone = "".join(k for k, v in MARKS.items() if not v)
    return F.regexp_replace(F.translate(text, kept + gone, "".join(v for v in MARKS.values() if v)), CONTROL, "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def line_key(line: Column) -> Column:
    """What makes two running lines equal: case, outer space and the digits don't count."""
    return F.regexp_replace(F.lower(strip(line)), r"\d+", "#")


def remove_running_lines(pages: DataFrame, book: str, page: str, text: str, share: float = 0.4, edge: int = 3) -> DataFrame:
    """``pages`` without the lines that recur at the top or bottom of many pages of a book.

    Only the edge lines of each page are exploded and counted; the few keys found go back to
    the pages of their book, which are filtered in place.
    """
    filled = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    n = F.size("_filled")
    edges = F.array(
        F.struct(F.lit("top").alias("side"), F.slice("_filled", 1, edge).alias("lines")),
        F.struct(F.lit("bottom").alias("side"), F.slice("_filled", F.greatest(n - edge + 1, F.lit(1)), F.lit(edge)).alias("lines")),
    )
    sides = pages.select(book, filled.alias("_filled")).select(book, F.explode(edges).alias("e")).select(book, "e.side", F.explode("e.lines").alias("line"))
    counts = sides.groupBy(book, "side", line_key(F.col("line")).alias("key")).agg(F.count("*").alias("c"))
    sizes = pages.groupBy(book).agg(F.count("*").alias("n_pages"))
    recurring = counts.join(sizes, book).where((F.col("n_pages") >= 3) & (F.col("c") / F.col("n_pages") >= share))
    keys = recurring.groupBy(book).agg(F.collect_set("key").alias("_keys"))
    kept = F.filter(F.split(text, "\n"), lambda x: ~((strip(x) != "") & F.array_contains(F.coalesce("_keys", F.array().cast("array<string>")), line_key(x))))
    return pages.join(keys, book, "left").withColumn(text, F.array_join(kept, "\n")).drop("_keys")


def blank_page_numbers(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(PAGE_NUMBER), "").otherwise(x)), "\n")


def dehyphenate(text: Column) -> Column:
    """Rejoin words broken at a line end; lookarounds reach the fixpoint in one pass."""
    return F.regexp_replace(text, r"(?U)-\n(?<=\w-\n)(?=\w)", "")


def join_soft_wraps(text: Column) -> Column:
    """Join each line to the one before it unless one of them ends or opens a block.

    A fold over the lines: the test looks at the line as merged so far.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.element_at(lines, 1).alias("held"))

    def add(acc: Column, cur: Column) -> Column:
        held = acc["held"]
        apart = (strip(cur) == "") | (strip(held) == "") | held.rlike(ENDS_CLAUSE) | cur.rlike(OPENS_ITEM) | held.rlike(CAPS_LINE)
        fresh = F.struct(F.concat(acc["out"], F.array(held)).alias("out"), cur.alias("held"))
        joined = F.concat(F.regexp_replace(held, r"\s+$", ""), F.lit(" "), F.regexp_replace(cur, r"^\s+", ""))
        return F.when(apart, fresh).otherwise(F.struct(acc["out"].alias("out"), joined.alias("held")))

    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, add, lambda acc: F.array_join(F.concat(acc["out"], F.array(acc["held"])), "\n"))


def tidy_space(text: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(text, "[ \t]+", " "), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def clean_pages(pages: DataFrame, book: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(book, cleaned_text): all steps in order; pages are joined by a blank line."""
    marked = pages.select(book, page, plain_marks(nfkc(F.col(text))).alias(text))
    kept = remove_running_lines(marked, book, page, text).withColumn(text, blank_page_numbers(F.col(text)))
    whole = kept.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x[text]), "\n\n")
    return whole.select(book, tidy_space(join_soft_wraps(dehyphenate(joined))).alias("cleaned_text"))
