"""Queries on cleaning and document structure, over documents and adversarial inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..operators import cleaning as C
from ..operators import structure as T
from .catalog import BOOK_SQL, book_of, query, table
from .duck import Inline, in_list, text

#: Inline pages that exercise what the fixture tables lack; ids below zero.
FX = Inline("doc_id long, page long, text string", [
    (-1, 1, "ANNUAL REPORT 2020\nThe auto-\nmatic gener-\nation of text is\na common task\nPage 1 of 3"),
    (-1, 2, "Annual Report 2021\nINTRODUCTION\nIt works well, Dr. Smith said. It was 3.14 in 1990. The end.\n  Page 2 of 3  "),
    (-1, 3, "annual report 2022\n- a bullet\nfollowing line\n1.1 Background\niv\n\n\n\nmild\nPage 3 of 3"),
    (-2, 1, "1. Overview\nPlain words, nothing more than that\n1.1.2 Details\nABC\nDEF\nghi jkl\n2020 was a good year"),
    (-2, 2, "Summary: what we found\nOsmosis And Diffusion\nA b-\nc-\nd word\t\t here   \n\n\n\n  last  line  \n"),
    (-3, 1, 'He met Prof. Jones at 5 p.m. Today he left. "Why?" (Nobody knows.) See e.g. Fig. 3 and i.e. this. Versions 2.0 And on!\nÉté was nice. It is 5. Next'),
    (-4, 1, ""),
    (-5, 1, "tiny"),
])
PAGES = f"(SELECT {BOOK_SQL} AS book, doc_id AS page, text FROM documents UNION ALL SELECT 'fx' || doc_id, page, text FROM {FX.sql})"
TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id * 10 - page AS doc_id, text FROM {FX.sql})"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(book_of().alias("book"), F.col("doc_id").alias("page"), "text")
    return docs.unionByName(FX.spark(spark).select(F.concat(F.lit("fx"), "doc_id").alias("book"), "page", "text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(FX.spark(spark).select((F.col("doc_id") * 10 - F.col("page")).alias("doc_id"), "text"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_KEY = "regexp_replace(lower(" + _TRIM.format("{}") + "), '\\d+', '#', 'g')"


@query(
    "clean_headers_footers",
    f"""WITH p AS (SELECT book, page, string_split(text, chr(10)) AS lines FROM {PAGES}),
f AS (SELECT book, page, list_filter(lines, lambda x: {_TRIM.format('x')} <> '') AS filled FROM p),
e AS (SELECT book, 'top' AS side, unnest(filled[1:3]) AS line FROM f UNION ALL SELECT book, 'bottom', unnest(filled[greatest(len(filled) - 2, 1):len(filled)]) FROM f),
c AS (SELECT book, side, {_KEY.format('line')} AS key, count(*) AS c FROM e GROUP BY ALL),
n AS (SELECT book, count(*) AS n FROM p GROUP BY book),
k AS (SELECT book, list(DISTINCT key) AS keys FROM c JOIN n USING (book) WHERE n >= 3 AND c::DOUBLE / n >= 0.4 GROUP BY book)
SELECT book, page, array_to_string(list_filter(lines, lambda x: NOT ({_TRIM.format('x')} <> '' AND list_contains(coalesce(keys, []), {_KEY.format('x')}))), chr(10)) AS text FROM p LEFT JOIN k USING (book)""",
)
def clean_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_running_lines(_pages(spark, sf_dir), "book", "page", "text").select("book", "page", "text")


@query("clean_page_numbers", f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, {text(C.PAGE_NUMBER)}) THEN '' ELSE x END), chr(10)) AS text FROM {TEXTS}")
def clean_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", C.blank_page_numbers(F.col("text")).alias("text"))


_W = r"[\p{L}\p{N}_]"


def _dehyphen(x: str) -> str:
    return f"regexp_replace({x}, '({_W})-\\n({_W})', '\\1\\2', 'g')"


@query("clean_dehyphenate", f"SELECT doc_id, {_dehyphen(_dehyphen('text'))} AS text FROM {TEXTS}")
def clean_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", C.dehyphenate(F.col("text")).alias("text"))


@query(
    "clean_whitespace",
    f"""SELECT doc_id, {_TRIM.format("regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[ ' || chr(9) || ']+', ' ', 'g'), chr(10)), lambda x: " + _TRIM.format('x') + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM {TEXTS}""",
)
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", C.tidy_space(F.col("text")).alias("text"))


def _apart(held: str, cur: str) -> str:
    return f"({_TRIM.format(cur)} = '' OR {_TRIM.format(held)} = '' OR regexp_matches({held}, {text(C.ENDS_CLAUSE)}) OR regexp_matches({cur}, {text(C.OPENS_ITEM)}) OR regexp_matches({held}, {text(C.CAPS_LINE)}))"


_HELD = "regexp_extract(a, '([^\\n]*)$', 1)"


@query(
    "clean_join_lines",
    f"""SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')),
  lambda a, x: CASE WHEN {_apart(_HELD, 'x')} THEN a || chr(10) || x ELSE a || ' ' || regexp_replace(x, '^\\s+', '') END) AS text FROM {TEXTS}""",
)
def clean_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", C.join_soft_wraps(F.col("text")).alias("text"))


MARKED = Inline("id long, text string", [(1, "‘a’ “b” c–d—e f﻿g"), (2, "x\x07y\x1fz\tq"), (3, "ﬁne ½ Å"), (4, "")])
_TRANSLATED = f"translate(text, {text(''.join(k for k, v in C.MARKS.items() if v))}, {text(''.join(v for v in C.MARKS.values() if v))})"


@query("clean_marks", f"SELECT id, regexp_replace(replace({_TRANSLATED}, {text(chr(0xFEFF))}, ''), {text(C.CONTROL)}, '', 'g') AS text FROM (SELECT id, text FROM {MARKED.sql} UNION ALL SELECT 100 + doc_id, text FROM documents)")
def clean_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    return MARKED.spark(spark).unionByName(docs).select("id", C.plain_marks(F.col("text")).alias("text"))


@query("clean_unicode")
def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    return MARKED.spark(spark).unionByName(docs).select("id", C.plain_marks(C.nfkc(F.col("text"))).alias("text"))


@query("clean_pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_pages(_pages(spark, sf_dir), "book", "page", "text")


_PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"
_LINES = f"(SELECT doc_id, text AS doc, unnest(ps) AS line, unnest(range(len(ps))) AS line_index FROM (SELECT doc_id, text, {_PARAS} AS ps FROM {TEXTS}))"
_WORDS = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))"
_FIRST = "regexp_replace(lower(regexp_split_to_array(line, '\\s+')[1]), '^:+|:+$', '', 'g')"
_NUM = f"regexp_extract(line, {text(T.NUMBERED)}, 1)"
_SHORT = f"{_WORDS} <= 8 AND NOT regexp_matches(line, '[.!?,;]\\s*$') AND (regexp_matches(line, '^\\p{{Lu}}') OR {in_list(_FIRST, T.HEADING_WORDS)})"
_LEVEL = f"""CASE WHEN line = '' OR regexp_matches(line, {text(T.BULLET)}) OR length(line) > 90 THEN 0
  WHEN regexp_matches(line, {text(T.NUMBERED)}) THEN least(length({_NUM}) - length(replace({_NUM}, '.', '')) + 1, 4)
  WHEN regexp_matches(line, {text(T.ALL_CAPS)}) AND {_WORDS} <= 12 AND regexp_matches(line, '\\p{{L}}') THEN 1
  WHEN {_SHORT} AND {in_list(_FIRST, T.HEADING_WORDS)} THEN 1 WHEN {_SHORT} AND regexp_matches(line, {text(T.TITLE_CASE)}) THEN 2 ELSE 0 END"""


@query("headings_textual", f"SELECT doc_id, line_index, line AS text, level, strpos(doc, line) - 1 AS char_offset FROM (SELECT *, ({_LEVEL})::BIGINT AS level FROM {_LINES}) WHERE level > 0")
def headings_textual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.headings(_texts(spark, sf_dir))


FONTS = Inline("doc_id long, line string, size double", [(-21, "1. Overview", 10.0), (-21, "Plain words, nothing more than that", 16.0), (-21, "ghi jkl", 12.0), (-21, "ABC", 10.0), (-21, "ABC", 9.0)])


@query(
    "headings_font",
    f"""WITH one AS (SELECT doc_id, {_TRIM.format('line')} AS line, max(size) AS size FROM {FONTS.sql} GROUP BY ALL), med AS (SELECT doc_id, median(size) AS med FROM one GROUP BY doc_id),
l AS (SELECT *, ({_LEVEL})::BIGINT AS base FROM {_LINES} LEFT JOIN one USING (doc_id, line) LEFT JOIN med USING (doc_id)),
x AS (SELECT *, CASE WHEN coalesce(size >= 1.4 * med AND len(regexp_split_to_array(line, '\\s+')) <= 15, false) THEN 1 WHEN coalesce(size >= 1.15 * med, false) AND base = 0 THEN 2 ELSE base END AS level FROM l)
SELECT doc_id, line_index, line AS text, level::BIGINT AS level, strpos(doc, line) - 1 AS char_offset FROM x WHERE level > 0""",
)
def headings_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.headings(_texts(spark, sf_dir), FONTS.spark(spark))


def sentences_sql(x: str) -> str:
    dot, cut, edge = text(T._DOT), text(T._CUT), "(^|[^\\p{L}\\p{N}_])"
    s = _TRIM.format(x)
    for a in sorted((a for a in T.ABBREVIATIONS if "." in a), key=lambda a: (-len(a), a)):
        h, t = a.split(".")
        s = f"regexp_replace({s}, '(?i){edge}({h})\\.({t})\\.', '\\1\\2' || {dot} || '\\3' || {dot}, 'g')"
    plain = "|".join(sorted((a for a in T.ABBREVIATIONS if "." not in a), key=lambda a: (-len(a), a)))
    s = f"regexp_replace({s}, '(?i){edge}({plain})\\.', '\\1\\2' || {dot}, 'g')"
    s = f"regexp_replace({s}, '([0-9])\\.', '\\1' || {dot}, 'g')"
    s = f"""regexp_replace({s}, '([.!?]["'')\\]]?)\\s+([A-Z0-9"''(\\[])', '\\1' || {cut} || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({s}, {cut}), lambda y: {_TRIM.format(f'''replace(y, {dot}, '.')''')}), lambda y: y <> '')"


_COUNT = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+(?:[''’][\\p{{L}}\\p{{N}}_]+)*|[^\\p{{L}}\\p{{N}}_\\s]'))"
SENTENCES = f"""(SELECT doc_id, line_index, unnest(ss) AS sentence, unnest(range(len(ss))) AS i FROM (SELECT doc_id, line_index, {sentences_sql('line')} AS ss FROM {_LINES}))"""


@query("sentences_split", f"SELECT doc_id, line_index, i, sentence FROM {SENTENCES}")
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("line_index", "line"))
    out = lines.select("doc_id", F.col("line_index").cast("long").alias("line_index"), F.posexplode(T.sentences(F.col("line"))).alias("i", "sentence"))
    return out.withColumn("i", F.col("i").cast("long"))


@query("token_counts", f"SELECT doc_id, {_COUNT.format('text')} AS n_tokens FROM {TEXTS}")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


#: Chunks by a recursive walk over running token sums.
CHUNKS = f"""WITH RECURSIVE s AS (SELECT doc_id, line_index, sentence, {_COUNT.format('sentence')} AS n, row_number() OVER w AS k, sum({_COUNT.format('sentence')}) OVER w AS upto
  FROM {SENTENCES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_index, i)),
sized AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
cut AS (SELECT a.doc_id, a.k AS first, greatest(a.k, coalesce(max(b.k) FILTER (WHERE b.upto - (a.upto - a.n) <= {S.chunk_tokens}), a.k)) AS last
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k >= a.k AND (b.k = a.k OR b.upto - (a.upto - a.n) <= {S.chunk_tokens}) GROUP BY a.doc_id, a.k),
back AS (SELECT e.doc_id, e.k AS last, coalesce(min(b.k) FILTER (WHERE e.upto - (b.upto - b.n) <= {S.overlap_tokens}), e.k + 1) AS back
  FROM s e JOIN s b ON b.doc_id = e.doc_id AND b.k <= e.k AND (b.k = e.k OR e.upto - (b.upto - b.n) <= {S.overlap_tokens}) GROUP BY e.doc_id, e.k),
walk AS (SELECT doc_id, 0::BIGINT AS position, first, last FROM cut WHERE first = 1
  UNION ALL SELECT w.doc_id, w.position + 1, c.first, c.last FROM walk w JOIN sized z ON z.doc_id = w.doc_id AND w.last < z.size
    JOIN back b ON b.doc_id = w.doc_id AND b.last = w.last JOIN cut c ON c.doc_id = w.doc_id AND c.first = CASE WHEN b.back > w.first THEN b.back ELSE w.last + 1 END),
chunk AS (SELECT w.doc_id, 'c' || position AS chunk_id, position, string_agg(sentence, ' ' ORDER BY k) AS text, min(line_index) AS first_line FROM walk w JOIN s ON s.doc_id = w.doc_id AND k BETWEEN first AND last GROUP BY w.doc_id, position)"""


@query("chunk_documents", f"{CHUNKS} SELECT doc_id, chunk_id, position, text, {_COUNT.format('text')} AS token_count FROM chunk")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(_texts(spark, sf_dir)).select("doc_id", "chunk_id", "position", "text", "token_count")


_HEADS = f"(SELECT doc_id, line_index, line FROM (SELECT *, ({_LEVEL})::BIGINT AS level FROM {_LINES}) WHERE level > 0)"


@query("chunk_heading_asof", f"{CHUNKS} SELECT c.doc_id, chunk_id, coalesce(arg_max(h.line, h.line_index), '') AS heading FROM chunk c LEFT JOIN {_HEADS} h ON h.doc_id = c.doc_id AND h.line_index <= first_line GROUP BY c.doc_id, chunk_id")
def chunk_heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(_texts(spark, sf_dir), headed=True).select("doc_id", "chunk_id", "heading")


@query(
    "sentence_index",
    f"""{CHUNKS}, own AS (SELECT doc_id, position AS chunk, chunk_id, {sentences_sql('text')} AS ss FROM chunk),
o AS (SELECT *, lag(ss) OVER (PARTITION BY doc_id ORDER BY chunk) AS prev FROM own),
x AS (SELECT doc_id, chunk, chunk_id, prev, unnest(ss) AS text, unnest(range(len(ss))) AS i FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, i) - 1 AS position, text, chunk_id, i AS sentence_index_in_chunk FROM x WHERE prev IS NULL OR NOT list_contains(prev, text)""",
)
def sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unnested(T.document_index(T.document_chunks(_texts(spark, sf_dir))), "sentences", "s").drop("heading")


_OCR = Inline("doc_id long, ocr_confidence double", [(-11, 0.4), (-12, 0.9), (-51, 0.9), (-21, None)])


@query(
    "ingest_flags",
    f"SELECT doc_id, length({_TRIM.format('text')}) AS cleaned_chars, ocr_confidence, length({_TRIM.format('text')}) < {S.min_total_chars} OR coalesce(ocr_confidence < {S.ocr_min_confidence}, false) AS needs_llm_ocr FROM {TEXTS} LEFT JOIN {_OCR.sql} USING (doc_id)",
)
def ingest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).join(_OCR.spark(spark), "doc_id", "left")
    return T.ingest_flags(docs.select("doc_id", F.col("text").alias("cleaned_text"), "ocr_confidence"))
