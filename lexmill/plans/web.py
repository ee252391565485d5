"""Queries on research, resources and connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..operators import research as R
from ..sources import connectors as K
from ..sources import files as FS
from .catalog import BOOK_SQL, book_of, query, table
from .duck import Inline, content_stems, text

URLS = Inline("id long, url string", list(enumerate(("https://Example.org/A/", "http://x.test/a).", "ftp://x.test/", "javascript:alert(1)", "not a url", "HTTPS://x.test/B!?", "", None), -8)))
_NORM = """lower(regexp_replace(regexp_replace(url, '[).,;:!?''"\\]]+$', ''), '/$', ''))"""
_ALL = f"(SELECT id, url FROM {URLS.sql} UNION ALL SELECT page_id, url FROM pages)"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return URLS.spark(spark).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


@query("url_normalise", f"SELECT id, {_NORM} AS url FROM {_ALL}")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", R.normal_url(F.col("url")).alias("url"))


@query("http_url_filter", f"SELECT id, coalesce(regexp_matches(url, '(?i)^https?://[^/\\s]+'), false) AS is_http FROM {_ALL}")
def http_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", R.is_http_url(F.col("url")).alias("is_http"))


@query("html_strip", "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '&#039;', ''''), '\\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.strip_html(F.col("html")).alias("text"))


RESULTS = Inline("request long, query_idx long, idx long, title string, url string", [
    (1, 0, 0, "a", "https://x.test/a/"), (1, 0, 1, "b", "https://x.test/b"), (1, 1, 0, "A again", "https://X.test/A."), (1, 1, 1, "c", "https://x.test/c"), (1, 2, 0, "d", "https://x.test/d"),
    (1, 2, 1, "e", "https://x.test/e"), (1, 2, 2, "f", "https://x.test/f"), (1, 0, 2, "g", "https://x.test/g"), (1, 1, 2, "h", "https://x.test/h"), (2, 0, 0, "z", "https://z.test"),
])
_RES = f"(SELECT * FROM {RESULTS.sql} UNION ALL SELECT 1000 + page_id % 25, page_id % 3, page_id, url, url FROM pages)"


@query(
    "research_round_robin_merge",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY request, {_NORM} ORDER BY idx, query_idx) AS o FROM {_RES}),
n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY idx, query_idx) AS n FROM o WHERE o = 1)
SELECT request, n, query_idx, title, url FROM n WHERE n <= {S.research_sources}""",
)
def research_round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.lit(1000) + F.col("page_id") % 25).alias("request"), (F.col("page_id") % 3).alias("query_idx"), F.col("page_id").alias("idx"), F.col("url").alias("title"), "url")
    return R.merge_results(RESULTS.spark(spark).unionByName(pages), "request").select("request", "n", "query_idx", "title", "url")


ISO = Inline("iso string", [(x,) for x in ("PT10M", "PT1H2M3S", "PT45S", "P1DT1H", "P0D", "junk", None, "P", "PT", "P2D")])
_ISO = " + ".join(f"coalesce(try_cast(regexp_extract(iso, {text(R.DURATION)}, {g}) AS BIGINT), 0) * {n}" for g, n in ((1, 86400), (2, 3600), (3, 60), (4, 1)))


@query("iso_duration", f"SELECT iso, CASE WHEN regexp_matches(iso, {text(R.DURATION)}) THEN {_ISO} END AS seconds FROM {ISO.sql}")
def iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ISO.spark(spark).select("iso", R.duration_seconds(F.col("iso")).alias("seconds"))


VIDEOS = Inline("video_id string, ord long, title string, published string, seconds long, views long", [
    ("a", 1, "Photosynthesis explained", "2024-01-01 00:00:00", 840, 1000000), ("a", 2, "Photosynthesis again", "2024-01-01 00:00:00", 840, 5), ("b", 3, "Light and plants", "2020-06-01 00:00:00", 1200, 5000), ("c", 4, "Photosynthesis in plants", None, 600, 0),
    ("d", 5, "Cooking", "2024-01-01 00:00:00", 600, 10), ("e", 6, "Plants", "2024-05-01 00:00:00", 100, 10), ("f", 7, "Plants", "2024-05-01 00:00:00", None, 10), ("g", 8, "Plant light", "2030-01-01 00:00:00", 2400, 99),
])
_VID = f"""(SELECT video_id, ord, title, published::TIMESTAMP AS published_at, seconds, views FROM {VIDEOS.sql}
UNION ALL SELECT 'ev' || event_id, 100 + event_id, event_type || ' plants', ts::TIMESTAMP, (value * 10)::INTEGER, (value * 1000)::BIGINT FROM events)"""
_NOW, _ASK, _VW = "2025-01-01 00:00:00", "photosynthesis in plants", S.video_weights
_STEMS = f"list_distinct({content_stems(text(_ASK))})"


@query(
    "video_rank",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS o, seconds / 60::DOUBLE AS m FROM {_VID}),
t AS (SELECT *, len(list_filter({_STEMS}, lambda x: list_contains({content_stems('title')}, x))) / len({_STEMS})::DOUBLE AS t FROM o WHERE o = 1 AND m BETWEEN {S.video_min_minutes} AND {S.video_max_minutes}),
s AS (SELECT *, floor(round(({_VW['title']}::DOUBLE * t + {_VW['views']}::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, log10(views + 1::DOUBLE) / 6)) + {_VW['recency']}::DOUBLE / (1 + coalesce(greatest(0::DOUBLE, (epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(published_at))) / 31557600::DOUBLE), 8) / 3)
 + {_VW['duration']}::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, 1 - 0.5::DOUBLE * abs(m - 14) / 26))) / {sum(_VW.values())}::DOUBLE * 1000, 9) + 0.5::DOUBLE) / 1000 AS score FROM t WHERE t > 0)
SELECT video_id, floor(m * 10 + 0.5::DOUBLE) / 10 AS minutes, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM s QUALIFY rank <= {S.video_results}""",
)
def video_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = VIDEOS.spark(spark).select("video_id", "ord", "title", F.col("published").cast("timestamp").alias("published_at"), "seconds", "views")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev"), "event_id").alias("video_id"), (F.col("event_id") + 100).alias("ord"), F.concat("event_type", F.lit(" plants")).alias("title"), F.col("ts").cast("timestamp").alias("published_at"),
        F.rint(F.col("value") * 10).cast("long").alias("seconds"), F.rint(F.col("value") * 1000).cast("long").alias("views"),  # halves to even, as a cast in SQL
    )
    return R.rank_videos(fx.unionByName(events), _ASK, _NOW)


TOPIC = Inline("id long, message string", list(enumerate(("research the latest on artificial photosynthesis", "find videos about it", "please look it up online", "What is the role of ATP?", "study resources for me, please", "tell me about the Krebs cycle and the electron transport chain in plants and in animals today"), 1)))
_CLEAN = f"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(message, {text(R.FILLER)}, ' ', 'g'), '[?!.,]+', ' ', 'g'), '\\s+', ' ', 'g')), {text(R.LEAD)}, '')"


@query("topic_extraction", f"SELECT id, CASE WHEN len({content_stems(_CLEAN)}) >= 1 THEN array_to_string(string_split({_CLEAN}, ' ')[1:12], ' ') ELSE '' END AS topic FROM (SELECT id, message FROM {TOPIC.sql} UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user')")
def topic_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.col("text").alias("message"))
    return TOPIC.spark(spark).unionByName(talk).select("id", R.extract_topic(F.col("message")).alias("topic"))


QUERIES = Inline("doc_id long, title string, user_query string, keywords array<string>, topic1 array<string>, topic2 array<string>, queries string", [
    (1, "Bio", "", ["light", "carbon cycle", "atp", "enzyme", "sugar"], ["light", "energy"], ["root", "soil"], "light carbon cycle atp|light energy light|root soil explained"),
    (2, "Bio", "how plants grow", ["light"], ["energy"], [], "how plants grow|how plants grow light|how plants grow energy overview"),
    (3, "Only a title", None, [], [], [], "Only a title"), (4, None, "", [], [], [], ""),
])


@query("research_queries", f"SELECT doc_id, queries FROM {QUERIES.sql}")
def research_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = QUERIES.spark(spark).withColumn("topics", F.filter(F.array("topic1", "topic2"), lambda t: F.size(t) > 0))
    return R.research_queries(docs).select("doc_id", F.array_join("queries", "|").alias("queries"))


SUMMARIES = Inline("id long, summary string, url1 string, url2 string", [
    (-1, "Plants [1, 9] use light (see https://X.test/a/). Also   https://invented.test/x, [3] and [2][7].", "https://x.test/a", "https://x.test/b"),
    (-2, "No references at all.  Two  spaces ( )", "https://x.test/a", "https://x.test/b"), (-3, None, "https://x.test/a", "https://x.test/b"), (-4, "[12] HTTPS://X.TEST/B; end", "https://x.test/a", "https://x.test/b"),
])
_SUMS = f"(SELECT * FROM {SUMMARIES.sql} UNION ALL SELECT page_id, 'See ' || url || '. Also https://invented.test/x and [2], [7] (https://no.test).', url, url || '/more' FROM pages)"
_PLAIN = """lower(regexp_replace(regexp_replace({}, '[).,;:!?''"\\]]+$', ''), '/$', ''))"""
_CORE, _END = "regexp_replace(t, '[.,;:!?]*$', '')", "regexp_extract(t, '[.,;:!?]*$')"
_SHOWN = rf"""list_transform(regexp_extract_all(s, {text(R.REFERENCE)}), lambda t: CASE
  WHEN starts_with(t, '[') THEN array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(t, '[\[\]\s]', '', 'g'), ','), lambda x: x::INTEGER), lambda n: n BETWEEN 1 AND 2), lambda n: '[' || n || ']'), '')
  WHEN {_PLAIN.format(_CORE)} = {_PLAIN.format('url2')} THEN '[2]' || {_END} WHEN {_PLAIN.format(_CORE)} = {_PLAIN.format('url1')} THEN '[1]' || {_END} ELSE {_END} END)"""


@query(
    "summary_sanitiser",
    f"""WITH x AS (SELECT id, coalesce(summary, '') AS s, url1, url2 FROM {_SUMS}), y AS (SELECT id, regexp_split_to_array(s, {text(R.REFERENCE)}) AS gaps, {_SHOWN} AS shown FROM x)
SELECT id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(shown[i], '')), ''), '[ \t]{{2,}}', ' ', 'g'), '\\(\\s*\\)', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text,
len(list_filter(shown, lambda t: NOT starts_with(t, '['))) AS removed FROM y""",
)
def summary_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that cite page URLs, known and unknown; the sources of each are two pages."""
    body = F.concat(F.lit("See "), "url", F.lit(". Also https://invented.test/x and [2], [7] (https://no.test)."))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), body.alias("summary"), F.col("url").alias("url1"), F.concat("url", F.lit("/more")).alias("url2"))
    rows = SUMMARIES.spark(spark).unionByName(pages)
    sources = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"url{n}").alias("url")) for n in (1, 2)])
    shown, removed = R.sanitise_summary(F.col("summary"), sources)
    return rows.select("id", shown.alias("text"), removed.alias("removed"))


TRIES = Inline("query_id long, prio long, provider string, n_results long, results string, error string", [(1, 0, "t", 0, None, "timeout"), (1, 1, "w", 2, "r1", None), (1, 2, "s", 3, "r2", None), (2, 0, "t", 1, "r3", None), (3, 0, "t", 0, None, "bad key"), (3, 1, "w", 0, None, "empty")])


@query(
    "provider_fallback",
    f"""WITH w AS (SELECT *, min(CASE WHEN n_results > 0 THEN prio END) OVER (PARTITION BY query_id) AS w FROM {TRIES.sql})
SELECT query_id, max(CASE WHEN prio = w THEN provider END) AS provider, max(CASE WHEN prio = w THEN results END) AS results, coalesce(string_agg(provider || ': ' || error, '; ' ORDER BY prio) FILTER (WHERE error IS NOT NULL AND coalesce(prio < w, true)), '') AS errors FROM w GROUP BY query_id""",
)
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_provider(TRIES.spark(spark))


OCR = Inline("doc_id long, page_number long, engine string, engine_order long, confidence double", [(1, 1, "e", 0, 0.8), (1, 1, "t", 1, 0.9), (1, 2, "e", 0, 0.5), (1, 2, "t", 1, 0.6), (1, 3, "e", 0, 0.4), (1, 3, "t", 1, 0.4), (2, 1, "t", 1, 0.0)])


@query(
    "best_ocr_engine",
    f"""WITH g AS (SELECT *, min(CASE WHEN confidence >= {S.ocr_good_confidence} THEN engine_order END) OVER (PARTITION BY doc_id, page_number) AS g FROM {OCR.sql})
SELECT doc_id, page_number, arg_max(engine, confidence * 1000 - engine_order) AS engine, max(confidence) AS confidence FROM g WHERE g IS NULL OR engine_order <= g GROUP BY doc_id, page_number""",
)
def best_ocr_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_ocr(OCR.spark(spark), S.ocr_good_confidence)


_PG = f"(SELECT {BOOK_SQL} AS doc_id, doc_id AS page_number, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE text END AS text FROM documents)"


@query("ocr_page_budget", f"SELECT doc_id, page_number, length(trim(text)) < {S.min_page_chars} AS scanned, length(trim(text)) < {S.min_page_chars} AND sum((length(trim(text)) < {S.min_page_chars})::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_number) <= 10 AS uses_ocr FROM {_PG}")
def ocr_page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(book_of().alias("doc_id"), F.col("doc_id").alias("page_number"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    return K.ocr_pages(pages, 10, S.min_page_chars).select("doc_id", "page_number", "scanned", "uses_ocr")


UPLOADS = Inline("name string, mime string, size long", [("a.PDF", "application/octet-stream", 10), ("b", "image/png", 5), ("c.jpeg", "", 0), ("d.md", "text/markdown", 7), ("e.exe", "application/x", 9), ("f.txt", "text/plain", 30_000_000), ("g", "application/pdf", 3)])


@query("source_types", f"SELECT name, CASE WHEN lower(mime) = 'application/pdf' OR lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(mime) LIKE 'image/%' OR regexp_matches(lower(name), '\\.({'|'.join(FS.IMAGE_EXTENSIONS)})$') THEN 'image' WHEN lower(mime) LIKE 'text/%' OR regexp_matches(lower(name), '\\.(txt|md)$') THEN 'text' ELSE 'unknown' END AS source_type FROM {UPLOADS.sql}")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UPLOADS.spark(spark).select("name", FS.source_type(F.col("mime"), F.col("name")).alias("source_type"))


@query("accepted_uploads", f"SELECT name FROM {UPLOADS.sql} WHERE mime IN ({', '.join(text(m) for m in FS.ALLOWED)}) AND size BETWEEN 1 AND {S.max_upload_bytes}")
def accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.accepted_uploads(UPLOADS.spark(spark)).select("name")


@query("cache_misses", "SELECT item_id, sha256('system' || '␟' || text) AS key FROM benchmark WHERE NOT (text < 'M')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.lit("system").alias("system"), F.col("text").alias("prompt"))
    cache = asked.where("prompt < 'M'").select(F.sha2(F.concat_ws("␟", "system", "prompt"), 256).alias("key"))
    return K.missing_from_cache(asked, cache).select("item_id", "key")
