"""Injectable connectors: whatever lies outside the engine comes in as a callable or a table.

No connector touches the network.  A fetcher is a Python callable from a request to a list of
result dictionaries; the default reads a table of recorded results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Fetcher = Callable[[str], list[dict]]
RESULT = "query_idx long, query string, provider string, prio int, idx long, title string, url string, snippet string"


def fetch_results(queries: DataFrame, fetchers: list[tuple[str, Fetcher]], snippet_chars: int = 500) -> DataFrame:
    """Results of every provider for every (query_idx, query), fetched where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for pdf in batches:
            rows = [
                (q.query_idx, q.query, name, prio, i, r.get("title"), r.get("url"), (r.get("snippet") or "")[:snippet_chars])
                for q in pdf.itertuples()
                for prio, (name, fetch) in enumerate(fetchers)
                for i, r in enumerate(fetch(q.query))
            ]
            yield pd.DataFrame(rows, columns=names)

    return queries.select("query_idx", "query").mapInPandas(run, RESULT)


def first_provider(tries: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, provider, results, errors): the first provider with a result, and what failed before it.

    ``tries`` is (by, prio, provider, n_results, results, error).
    """
    won = F.min(F.when(F.col("n_results") > 0, F.col("prio"))).over(Window.partitionBy(by))
    marked = tries.withColumn("_w", won)
    failed = F.when(F.coalesce(F.col("prio") < F.col("_w"), F.lit(True)) & F.col("error").isNotNull(), F.struct("prio", F.concat_ws(": ", "provider", "error").alias("e")))
    out = marked.groupBy(by).agg(F.min_by("provider", F.when(F.col("prio") == F.col("_w"), F.col("prio"))).alias("provider"), F.min_by("results", F.when(F.col("prio") == F.col("_w"), F.col("prio"))).alias("results"), F.array_sort(F.collect_list(failed)).alias("e"), F.max("_w").alias("_w"))
    found = F.col("_w").isNotNull()
    return out.select(by, F.when(found, F.col("provider")).alias("provider"), F.when(found, F.col("results")).alias("results"), F.array_join(F.transform("e", lambda x: x["e"]), "; ").alias("errors"))


def best_ocr(tries: DataFrame, good: float, by: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """The engine whose text is kept: the first that is good enough, else the most confident, the earlier on a tie."""
    first_good = F.min(F.when(F.col("confidence") >= good, F.col("engine_order"))).over(Window.partitionBy(*by))
    seen = tries.withColumn("_g", first_good).where(F.col("_g").isNull() | (F.col("engine_order") <= F.col("_g")))
    return seen.groupBy(*by).agg(F.max_by(F.struct("engine", "confidence"), F.struct("confidence", -F.col("engine_order"))).alias("b")).select(*by, "b.engine", "b.confidence")


def ocr_pages(pages: DataFrame, budget: int, min_chars: int) -> DataFrame:
    """Pages with (scanned, uses_ocr): short pages are scanned, the first ``budget`` of a document get OCR."""
    scanned = F.length(F.trim("text")) < min_chars
    turn = F.sum(scanned.cast("int")).over(Window.partitionBy("doc_id").orderBy("page_number"))
    return pages.withColumn("scanned", scanned).withColumn("uses_ocr", scanned & (turn <= budget))


def missing_from_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (system, prompt) whose key isn't in ``cache`` (key), with their key."""
    keyed = requests.withColumn("key", F.sha2(F.concat_ws("␟", "system", "prompt"), 256))
    return keyed.join(cache.select("key"), "key", "left_anti")


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around its JSON."""
    return F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?i)^```json\s*|^```\s*", ""), r"```\s*$", "")


def kept_try(tries: DataFrame, retries: int = 2) -> DataFrame:
    """(request, provider, attempts, result, error): the outcome of (request, prio, provider, attempt,
    result, error, transient) under retry with fallback.

    A transient error is tried again up to ``retries`` times, any other ends the provider's turn;
    the first provider with a result wins, its last error is told if none has one.
    """
    turn = Window.partitionBy("request", "prio").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    over = F.max((F.col("result").isNotNull() | ~F.col("transient")).cast("int")).over(turn)
    made = tries.where(F.col("attempt") <= retries + 1).withColumn("_o", F.coalesce(over, F.lit(0))).where("_o = 0")
    last = made.groupBy("request", "prio", "provider").agg(F.max("attempt").alias("attempts"), F.max_by("result", "attempt").alias("result"), F.max_by("error", "attempt").alias("error"))
    order = F.struct(F.col("result").isNull().alias("none"), F.when(F.col("result").isNull(), -F.col("prio")).otherwise(F.col("prio")).alias("p"))
    won = last.groupBy("request").agg(F.min_by(F.struct("provider", "attempts", "result", "error"), order).alias("b"))
    return won.select("request", "b.*")


def wait_seconds(attempt: Column) -> Column:
    """Linear backoff after a failed attempt, counted from 1."""
    return attempt * 0.5


def videos(found: DataFrame, details: DataFrame) -> DataFrame:
    """Search hits (query, ord, video_id) with their details (video_id, title, duration, views,
    published); what a video doesn't tell is empty, 0 or null, hits without details go."""
    from ..operators.research import duration_seconds

    told = details.select(
        "video_id", F.coalesce("title", F.lit("")).alias("title"), duration_seconds(F.col("duration")).alias("seconds"), F.coalesce("views", F.lit(0)).cast("long").alias("views"), "published",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"),
    )
    return found.join(told, "video_id")


def reingested(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, text, llm_ocr_used, warning): documents (doc_id, source_type, text, needs_llm_ocr) with
    the text of an outside extractor (doc_id, extracted, error) where theirs was poor.

    Only PDFs and images are extracted again; a blank or failed extraction keeps what was there.
    """
    asked = F.col("needs_llm_ocr") & F.col("source_type").isin("pdf", "image")
    both = docs.join(extracted, "doc_id", "left")
    used = F.coalesce(asked & (F.trim("extracted") != ""), F.lit(False))
    warning = F.when(asked & F.col("error").isNotNull(), F.concat(F.lit("LLM OCR fallback failed: "), "error"))
    return both.select("doc_id", F.when(used, F.col("extracted")).otherwise(F.col("text")).alias("text"), used.alias("llm_ocr_used"), warning.alias("warning"))


def ocr_confidence(words: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number", "engine")) -> DataFrame:
    """Mean confidence of an engine's words, as a share: percent values of at least 0 count; an engine
    that gives none at all (paragraph mode) is taken at 0.7, one with only negative ones at 0."""
    told = F.avg(F.when(F.col("conf") >= 0, F.col("conf") / 100))
    return words.groupBy(*by).agg(F.when(F.count("conf") == 0, 0.7).otherwise(F.coalesce(told, F.lit(0.0))).alias("confidence"))
