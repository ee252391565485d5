"""Queries on stores, requests, replies and the other parts a service is made of.

Most act on inline rows, since the tables hold nothing of the kind; where a table can stand in,
it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..operators import analyze as AN
from ..operators import assess as A
from ..operators import chat as C
from ..operators import evaluate as E
from ..operators import keywords as K
from ..operators import research as R
from ..operators import routing as RT
from ..operators import structure as T
from ..sources import connectors as CN
from ..sources import files as FS
from ..sources import scratch, store
from .analysis import _IMP, _MERGE, _RAKE, _TFIDF, _YAKE, tfidf_sql
from .catalog import query, table
from .duck import Inline, text
from .text import CHUNKS, TEXTS, _texts, sentences_sql

REQUESTS = Inline("id long, count string, difficulty string, type string, mode string", [
    (1, None, None, None, None), (2, "3", "hard", "mcq", "exam"), (3, "2.5", "easy", "short", "knowledge"), (4, "0", None, None, None), (5, "99", None, None, None), (6, "many", None, None, None), (7, "4", "odd", None, None), (8, "4", None, "essay", None), (9, "4", None, None, "x"),
])
_N = "floor(try_cast(coalesce(count, '5') AS DOUBLE) + 0.5::DOUBLE)::BIGINT"


def _bad(name: str, default: str, allowed: tuple[str, ...]) -> str:
    return f"WHEN coalesce({name}, '{default}') NOT IN {allowed} THEN '{name} must be one of: {', '.join(allowed)}'"


@query(
    "question_options",
    f"""SELECT id, {_N} AS count, coalesce(difficulty, 'medium') AS difficulty, coalesce(type, 'mixed') AS type, coalesce(mode, 'knowledge') AS mode,
CASE WHEN {_N} IS NULL OR {_N} NOT BETWEEN 1 AND {S.max_questions} THEN 'count must be an integer between 1 and {S.max_questions}' {_bad('difficulty', 'medium', A.DIFFICULTIES)} {_bad('type', 'mixed', A.TYPES)} {_bad('mode', 'knowledge', A.MODES)} END AS error FROM {REQUESTS.sql}""",
)
def question_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = A.question_options(*[F.col(c) for c in ("count", "difficulty", "type", "mode")])
    return REQUESTS.spark(spark).select("id", *[c.alias(n) for n, c in told.items()])


ASKED = Inline("doc_id string, qid string, source long", [("d", "q1", 1), ("d", "q2", 2), ("d", "q3", None), ("d", "q4", 9), ("e", "q1", 1)])
LABELS = Inline("doc_id string, label long, chunk_id string", [("d", 1, "c0"), ("d", 2, "c7"), ("e", 1, "c0")])
OF = Inline("doc_id string, ord long, topic_id string, label string, chunk_ids array<string>", [("d", 1, "t1", "Light", ["c0", "c1"]), ("d", 0, "t0", "Energy", ["c0"])])


@query(
    "question_sources",
    f"""WITH m AS (SELECT doc_id, chunk_id, arg_min(topic_id, ord) AS topic_id, arg_min(label, ord) AS label FROM (SELECT *, unnest(chunk_ids) AS chunk_id FROM {OF.sql}) GROUP BY ALL)
SELECT q.doc_id, qid, source, l.chunk_id, topic_id, coalesce(m.label, 'General') AS topic_label FROM {ASKED.sql} q LEFT JOIN {LABELS.sql} l ON l.doc_id = q.doc_id AND l.label = q.source LEFT JOIN m ON m.doc_id = q.doc_id AND m.chunk_id = l.chunk_id""",
)
def question_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_sources(ASKED.spark(spark), LABELS.spark(spark), OF.spark(spark))


ITEMS = Inline("attempt_id long, quiz_id string, qid string, response string, score double", [(1, "q", "a", "red", 0.0), (1, "q", "b", "water", 0.5), (2, "r", "z", "", 0.0)])
KEYS = Inline("quiz_id string, qid string, ord long, answer string, explanation string", [("q", "a", 1, "green", "because"), ("q", "b", 2, "water moves", "so"), ("r", "z", 1, "y", None)])


@query("attempt_review", f"SELECT quiz_id, qid, attempt_id, response, score, ord, answer, explanation FROM {ITEMS.sql} JOIN {KEYS.sql} USING (quiz_id, qid)")
def attempt_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attempt_review(ITEMS.spark(spark), KEYS.spark(spark))


@query("attempt_listing", "SELECT event_id AS attempt_id, user_id, event_type AS quiz_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events")
def attempt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for attempts: newest first for each user and type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), "user_id", F.col("event_type").alias("quiz_id"), F.col("ts").alias("created_at"))
    return A.attempt_listing(rows).drop("created_at")


ROUTED = Inline("id long, intent string, error string", [(1, "quiz", None), (2, "question", None), (3, "small_talk", None), (4, None, "timeout"), (5, "resources", None), (6, "doubt", None)])
_KIND = "CASE WHEN error IS NOT NULL THEN 'question' ELSE intent END"


@query(
    "route_dispatch",
    f"""SELECT id, {_KIND} AS intent, coalesce(CASE {_KIND} {' '.join(f"WHEN '{i}' THEN '{h}'" for i, h in C.HANDLERS.items())} END, 'answer') AS handler,
'intent routing failed (' || error || '); treating the message as a question' AS warning FROM {ROUTED.sql}""",
)
def route_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUTED.spark(spark).select("id", *[c.alias(n) for n, c in C.dispatched(F.col("intent"), F.col("error")).items()])


NOTES = Inline("id long, sufficient boolean, mode string, reranked boolean, labels array<string>", [(1, True, "exam", True, ["Light", "", "Roots"]), (2, False, "exam", False, []), (3, True, "knowledge", True, None), (4, False, "exam", True, [""])])
_NOTED = f"CASE WHEN sufficient THEN {text(C.NOTE_CLOSE)} ELSE {text(C.NOTE_POOR)} END"
_NAMED = "list_filter(coalesce(labels, []), lambda x: x <> '')"


@query(
    "retrieval_notes",
    f"SELECT id, {_NOTED} || CASE WHEN mode = 'exam' AND reranked THEN ' ' || {text(C.NOTE_EXAM)} ELSE '' END AS note, CASE WHEN len({_NAMED}) > 0 THEN array_to_string({_NAMED}, ', ') ELSE '(document not analyzed yet)' END AS topics FROM {NOTES.sql}",
)
def retrieval_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = C.retrieval_note(F.col("sufficient"), F.col("mode"), F.col("reranked"))
    return NOTES.spark(spark).select("id", note.alias("note"), C.topics_line(F.col("labels")).alias("topics"))


@query("mode_resolution", f"SELECT id, coalesce(mode, CASE WHEN id % 2 = 0 THEN 'exam' END, 'knowledge') AS mode FROM {REQUESTS.sql}")
def mode_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REQUESTS.spark(spark).select("id", C.resolve_mode(F.col("mode"), F.when(F.col("id") % 2 == 0, "exam")).alias("mode"))


@query("prompt_render", "SELECT item_id, 'Item ' || item_id || ': ' || text || ' {{id}} end' AS prompt FROM benchmark")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template over a table; what a value holds is never expanded."""
    values = {"id": F.col("item_id"), "text": F.concat("text", F.lit(" {{id}}")), "none": F.lit(None)}
    return table(spark, sf_dir, "benchmark").select("item_id", C.rendered("Item {{id}}: {{ text }}{{none}} end", values).alias("prompt"))


POINT_TOPICS = Inline("doc_id long, topic_id string, chunk_ids array<string>", [(1, "t0", ["c0", "c1"]), (1, "t1", ["c9"]), (2, "t0", ["c0"])])
POINT_SENTS = Inline("doc_id long, position long, chunk_id string, text string", [(d, p, f"c{p // 4}", f"sentence {p}") for d in (1, 2) for p in range(8 if d == 1 else 2)])
POINT_WORDS = Inline("doc_id long, rank long, term string", [(d, r, f"term {r}") for d in (1, 2) for r in range(1, 18)])


@query(
    "key_point_prompts",
    f"""WITH own AS (SELECT t.doc_id, topic_id, list(s.text ORDER BY position)[1:5] AS own FROM {POINT_TOPICS.sql} t JOIN {POINT_SENTS.sql} s ON s.doc_id = t.doc_id AND list_contains(chunk_ids, chunk_id) GROUP BY ALL),
f AS (SELECT doc_id, list(text ORDER BY position)[1:3] AS first FROM {POINT_SENTS.sql} GROUP BY doc_id), k AS (SELECT doc_id, list(term ORDER BY rank)[1:15] AS kw FROM {POINT_WORDS.sql} GROUP BY doc_id)
SELECT doc_id, topic_id, array_to_string(coalesce(own, first), '|') AS sentences, array_to_string(kw, '|') AS keywords FROM {POINT_TOPICS.sql} LEFT JOIN own USING (doc_id, topic_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def key_point_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.key_point_prompts(POINT_TOPICS.spark(spark), POINT_SENTS.spark(spark), POINT_WORDS.spark(spark))
    return out.select("doc_id", "topic_id", F.array_join("sentences", "|").alias("sentences"), F.array_join("keywords", "|").alias("keywords"))


_GOOD = '[{"topic":"Light","key_points":["a","b"],"important_terms":["x"]},{"topic":"Roots","key_points":[],"important_terms":[]}]'
POINT_LABELS = Inline("doc_id long, ord long, label string, topic string, points string, warnings string", [
    (1, 0, "t0", "Light", "a|b", ""), (1, 1, "t1", "Roots", "", ""), (2, 0, "t0", "Light", "a|b", "attempt 1: invalid key-points shape"), (2, 1, "t1", "Roots", "", "attempt 1: invalid key-points shape"),
    (3, 0, "only", "only", "", "attempt 1: invalid key-points shape|attempt 2: invalid key-points shape"), (4, 0, "none", "none", "", ""),
])
POINT_REPLIES = Inline("doc_id long, attempt long, reply string", [(1, 1, _GOOD), (2, 1, "not json"), (2, 2, _GOOD), (3, 1, _GOOD), (3, 2, '[{"topic":"x","key_points":["a"]}]'), (3, 3, '[{"topic":"late","key_points":[],"important_terms":[]}]')])


@query("key_points", f"SELECT doc_id, ord, topic, points, warnings FROM {POINT_LABELS.sql}")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.key_points(POINT_REPLIES.spark(spark), POINT_LABELS.spark(spark).select("doc_id", "ord", "label"))
    return out.select("doc_id", "ord", "topic", F.array_join("key_points", "|").alias("points"), F.array_join("warnings", "|").alias("warnings"))


TRIES = Inline("request long, prio long, provider string, attempt long, error string, valid boolean, result string", [
    (1, 0, "g", 1, None, False, "bad"), (1, 0, "g", 2, None, True, "good"), (1, 1, "h", 1, None, True, "late"), (2, 0, "g", 1, "down", False, None), (2, 0, "g", 2, None, True, "never asked"), (2, 1, "h", 1, None, True, "saved"),
    (3, 0, "g", 1, None, False, "x"), (3, 0, "g", 2, None, False, "y"), (3, 0, "g", 3, None, True, "too late"), (3, 1, "h", 1, "down", False, None),
])


@query(
    "structured_policy",
    f"""WITH l AS (SELECT *, max((error IS NOT NULL)::INTEGER) OVER (PARTITION BY request, prio ORDER BY attempt) AS b FROM {TRIES.sql} WHERE attempt <= 2),
w AS (SELECT * FROM l WHERE b = 0 AND valid QUALIFY row_number() OVER (PARTITION BY request ORDER BY prio, attempt) = 1)
SELECT r.request, provider, attempt, result, coalesce(prio > 0, false) AS fell_back FROM (SELECT DISTINCT request FROM {TRIES.sql}) r LEFT JOIN w USING (request)""",
)
def structured_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.structured_result(TRIES.spark(spark))


CALLS = Inline("request long, prio long, provider string, attempt long, result string, error string, transient boolean", [
    (1, 0, "g", 1, None, "429", True), (1, 0, "g", 2, "ok", None, False), (1, 1, "h", 1, "late", None, False), (2, 0, "g", 1, None, "401", False), (2, 0, "g", 2, "never", None, False), (2, 1, "h", 1, None, "503", True), (2, 1, "h", 2, "saved", None, False),
    (3, 0, "g", 1, None, "429", True), (3, 0, "g", 2, None, "500", True), (3, 0, "g", 3, None, "timeout", True), (3, 0, "g", 4, "too late", None, False), (3, 1, "h", 1, None, "bad key", False),
])


@query(
    "retry_policy",
    f"""WITH m AS (SELECT *, coalesce(max((result IS NOT NULL OR NOT transient)::INTEGER) OVER (PARTITION BY request, prio ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {CALLS.sql} WHERE attempt <= 3),
l AS (SELECT * FROM m WHERE o = 0 QUALIFY row_number() OVER (PARTITION BY request, prio ORDER BY attempt DESC) = 1)
SELECT request, provider, attempt AS attempts, result, error FROM l QUALIFY row_number() OVER (PARTITION BY request ORDER BY result IS NULL, CASE WHEN result IS NULL THEN -prio ELSE prio END) = 1""",
)
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CN.kept_try(CALLS.spark(spark))


FENCED = Inline("id long, reply string", [(1, "```json\n[1]\n```"), (2, "  ```\n{\"a\": 1}```  "), (3, "[2]"), (4, "```JSON [3] ```"), (5, "")])


@query("json_unfenced", f"SELECT id, regexp_replace(regexp_replace(trim(reply), '(?i)^```json\\s*|^```\\s*', ''), '```\\s*$', '') AS reply FROM {FENCED.sql}")
def json_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FENCED.spark(spark).select("id", CN.unfenced(F.col("reply")).alias("reply"))


FOUND = Inline("query string, ord long, video_id string", [("plants", 1, "a"), ("plants", 2, "b"), ("light", 1, "a"), ("light", 2, "gone")])
DETAILS = Inline("video_id string, title string, duration string, views long, published string", [("a", "Plants", "PT10M", 5, "2024-01-01"), ("b", None, "junk", None, None)])


@query("video_details", f"SELECT query, ord, video_id, coalesce(title, '') AS title, CASE video_id WHEN 'a' THEN 600 END::BIGINT AS seconds, coalesce(views, 0) AS views, published, 'https://www.youtube.com/watch?v=' || video_id AS url FROM {FOUND.sql} JOIN {DETAILS.sql} USING (video_id)")
def video_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CN.videos(FOUND.spark(spark), DETAILS.spark(spark))


POOR = Inline("doc_id long, source_type string, text string, needs_llm_ocr boolean", [(1, "pdf", "x", True), (2, "image", "y", True), (3, "text", "z", True), (4, "pdf", "fine", False), (5, "image", "w", True)])
AGAIN = Inline("doc_id long, extracted string, error string", [(1, "a whole text", None), (2, "  ", None), (3, "not asked", None), (4, "not asked", None), (5, None, "quota")])


@query(
    "ocr_reingest",
    f"""SELECT doc_id, CASE WHEN used THEN extracted ELSE text END AS text, used AS llm_ocr_used, CASE WHEN asked AND error IS NOT NULL THEN 'LLM OCR fallback failed: ' || error END AS warning
FROM (SELECT *, needs_llm_ocr AND source_type IN ('pdf', 'image') AS asked, coalesce(needs_llm_ocr AND source_type IN ('pdf', 'image') AND trim(extracted) <> '', false) AS used FROM {POOR.sql} LEFT JOIN {AGAIN.sql} USING (doc_id))""",
)
def ocr_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CN.reingested(POOR.spark(spark), AGAIN.spark(spark))


CONF = Inline("doc_id long, page_number long, engine string, conf double", [(1, 1, "t", 90.0), (1, 1, "t", -1.0), (1, 1, "t", 70.0), (1, 1, "e", None), (1, 2, "t", -1.0), (2, 1, "e", None)])


@query("ocr_confidence", f"SELECT doc_id, page_number, engine, round(CASE WHEN count(conf) = 0 THEN 0.7::DOUBLE ELSE coalesce(avg(CASE WHEN conf >= 0 THEN conf / 100 END), 0) END, 6) AS confidence FROM {CONF.sql} GROUP BY ALL")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CN.ocr_confidence(CONF.spark(spark)).withColumn("confidence", F.round("confidence", 6))


PROMPTS = Inline("path string, text string", [("/p/system_json.txt", "a\r\nb"), ("/p/Quiz_2.txt", "c"), ("/p/bad-name.txt", "d"), ("/p/readme.md", "e"), ("x.txt", "")])


@query("prompt_templates", f"SELECT regexp_extract(path, '([^/\\\\]+)\\.txt$', 1) AS name, replace(text, chr(13) || chr(10), chr(10)) AS template FROM {PROMPTS.sql} WHERE regexp_matches(regexp_extract(path, '([^/\\\\]+)\\.txt$', 1), '(?i)^[a-z0-9_]+$')")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.prompt_templates(PROMPTS.spark(spark))


LABELLED = Inline("query string, intent string", [(" quiz me ", " quiz "), ("", "quiz"), ("why", "nonsense"), ("explain", "doubt"), (None, "quiz")])


@query("labelled_rows", f"SELECT trim(query) AS query, trim(intent) AS intent FROM {LABELLED.sql} WHERE trim(query) <> '' AND trim(intent) IN ({', '.join(text(i) for i in RT.PRIORITY)})")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RT.load_labelled(LABELLED.spark(spark))


SPANS = Inline("doc_id long, page long, line_no long, line string, size double", [(1, 1, 1, "Title ", 20.0), (1, 1, 1, "Title ", 12.0), (1, 2, 1, "Title", 9.0), (1, 2, 2, "  ", 9.0), (2, 1, 1, "Body", 10.0)])


@query("font_hints", f"WITH l AS (SELECT doc_id, page, line_no, trim(line) AS line, max(size) AS size FROM {SPANS.sql} GROUP BY ALL) SELECT doc_id, line, arg_max(size, page * 1000 + line_no) AS size FROM l WHERE line <> '' GROUP BY ALL")
def font_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.font_hints(SPANS.spark(spark))


@query("fetched_results", "SELECT item_id AS query_idx, text AS query, p AS provider, CASE p WHEN 'a' THEN 0 ELSE 1 END AS prio, i AS idx, p || i AS title, 'https://' || p || '.test/' || i AS url, left(text, 500) AS snippet FROM benchmark, (SELECT 'a' AS p, 0 AS i UNION ALL SELECT 'b', 0 UNION ALL SELECT 'b', 1)")
def fetched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider is asked where the queries are; here the providers are made up."""
    fetchers = [(p, lambda q, p=p, n=n: [{"title": f"{p}{i}", "url": f"https://{p}.test/{i}", "snippet": q} for i in range(n)]) for p, n in (("a", 1), ("b", 2))]
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_idx"), F.col("text").alias("query"))
    return CN.fetch_results(asked, fetchers)


@query("csv_round_trip", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as CSV and read back; doubles have four places."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    path = scratch.folder(spark, "csv")
    FS.write_csv(table(spark, sf_dir, "embeddings").select("vec_id", "label", total.alias("total")), path)
    return spark.read.csv(path, header=True, schema="vec_id bigint, label bigint, total double")


STORED = Inline("doc_id long, user_id long, title string, created_at long, updated_at long", [(1, 1, "a", 1, 1), (2, 1, "b", 2, 2), (3, 2, "c", 1, 1), (2, 1, "b old", 2, 1)])
SENT = Inline("doc_id long, user_id long, title string, created_at long, updated_at long", [(2, 1, "b again", 2, 2), (4, 1, "d", 9, 9), (3, 2, "c older", 1, 0)])


@query(
    "document_store",
    f"""WITH b AS (SELECT *, 0 AS fresh FROM {STORED.sql} UNION ALL SELECT *, 1 FROM {SENT.sql}), u AS (SELECT * EXCLUDE (fresh) FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, fresh DESC) = 1)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, doc_id DESC) AS n FROM u""",
)
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(store.upserted(STORED.spark(spark), SENT.spark(spark)))


TURNS = Inline("session long, ord long, question string, answer string, failed boolean", [(0, 1, "q1", "a1", False), (0, 2, "q2", None, True), (0, 3, "q3", "a3", False), (-7, 1, "first", "reply", False)])
_OLD = "(SELECT conv_id AS session, turn AS seq, role, text AS content FROM conversations)"


@query(
    "session_upsert",
    f"""WITH l AS (SELECT session, max(seq) AS last FROM {_OLD} GROUP BY session), t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS k FROM {TURNS.sql} WHERE NOT failed),
s AS (SELECT session, coalesce(last + 1, 0) + 2 * k AS start, question, answer FROM t LEFT JOIN l USING (session))
SELECT * FROM {_OLD} UNION ALL SELECT session, start, 'user', question FROM s UNION ALL SELECT session, start + 1, 'assistant', answer FROM s""",
)
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    return store.with_turns(old, TURNS.spark(spark))


_TITLES = "(SELECT doc_id, left(text, 40) AS title, doc_id AS created FROM documents WHERE text IS NOT NULL)"
_SAID = "(SELECT d.doc_id, conv_id AS session, conv_id AS started, turn AS seq, c.text FROM conversations c JOIN documents d ON d.doc_id = (SELECT max(doc_id) FROM documents) - conv_id % 30)"


@query(
    "search_modal",
    f"""WITH d AS (SELECT * FROM {_TITLES}), n AS (SELECT * FROM d ORDER BY created DESC, doc_id LIMIT 25),
s AS (SELECT DISTINCT doc_id, session, started, title, created FROM {_SAID} JOIN n USING (doc_id) ), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY started DESC, session) AS turn_no FROM s QUALIFY turn_no <= 5),
h AS (SELECT m.doc_id, r.title, m.text, greatest(strpos(lower(m.text), 'an') - 31, 0) AS b FROM {_SAID} m JOIN r ON r.doc_id = m.doc_id AND r.session = m.session WHERE strpos(lower(m.text), 'an') > 0 ORDER BY r.created DESC, m.doc_id, r.turn_no, seq LIMIT 20)
SELECT 'title' AS kind, doc_id, title, NULL AS snippet FROM d WHERE contains(lower(title), 'an')
UNION ALL SELECT 'message', doc_id, title, CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, b + 1, 110), '\\s+', ' ', 'g') || CASE WHEN b + 110 < length(text) THEN '…' ELSE '' END FROM h""",
)
def search_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("doc_id").alias("created"))
    newest = docs.agg(F.max("doc_id").alias("_m"))
    talk = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(newest)).select((F.col("_m") - F.col("conv_id") % 30).alias("doc_id"), F.col("conv_id").alias("session"), F.col("conv_id").alias("started"), F.col("turn").alias("seq"), "text")
    return C.search_everything(docs, talk.join(docs.select("doc_id"), "doc_id", "left_semi"), " AN ")


LABELLED_TOPICS = Inline("doc_id long, ord long, label string, size long, terms array<string>", [(1, 0, "a, b", 2, []), (1, 1, "c", 5, ["c", "cc"]), (1, 2, "d,, e", 5, None), (2, 0, "x", 1, ["y"])])


@query("topic_term_lists", f"SELECT doc_id, string_agg(array_to_string(CASE WHEN len(terms) > 0 THEN terms ELSE list_filter(list_transform(string_split(label, ','), lambda x: trim(x)), lambda x: x <> '') END, '+'), '|' ORDER BY size DESC, ord) AS topics FROM {LABELLED_TOPICS.sql} GROUP BY doc_id")
def topic_term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.topic_terms(LABELLED_TOPICS.spark(spark))
    return out.select("doc_id", F.array_join(F.transform("topics", lambda t: F.array_join(t, "+")), "|").alias("topics"))


_WIKI = "(SELECT page_id % 25 AS request, page_id % 3 AS query_idx, page_id AS idx, 'https://w.test/' || (page_id % 40) AS url FROM pages)"


@query(
    "wiki_pages",
    f"""WITH o AS (SELECT * FROM {_WIKI} QUALIFY row_number() OVER (PARTITION BY request, url ORDER BY query_idx, idx) = 1)
SELECT request, query_idx, idx, url, row_number() OVER (PARTITION BY request ORDER BY query_idx, idx) AS n FROM o QUALIFY n <= 5""",
)
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select((page % 25).alias("request"), (page % 3).alias("query_idx"), page.alias("idx"), F.concat(F.lit("https://w.test/"), page % 40).alias("url"))
    return R.wiki_pages(rows)


_MANY = "[" + ", ".join(f'{{"title":"topic {i}"}}' for i in range(7)) + "]"
SUGGESTED = Inline("id long, reply string, topics string, books string", [
    (1, f'{{"topics":{_MANY},"books":[{{"title":"A Book","author":"Some One"}}]}}', "topic 0|topic 1|topic 2|topic 3|topic 4", "A Book"), (2, '{"topics":[{"title":" Light ","why":"see www.x.test"}]}', None, None), (3, '{"topics":[]}', None, None),
    (4, '{"topics":[{"title":" Light "}]}', "Light", ""), (5, "junk", None, None), (6, '{"topics":[{"title":"x"}]}', None, None), (7, '{"topics":[{"title":"fine"}],"books":[{"title":"B1","author":"x"}]}', None, None),
])


@query("suggestion_schema", f"SELECT id, topics, books FROM {SUGGESTED.sql}")
def suggestion_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics, books = R.suggestions(F.col("reply"))
    return SUGGESTED.spark(spark).select("id", F.array_join(topics, "|").alias("topics"), F.array_join(books, "|").alias("books"))


BRANCHES = Inline("request long, ord long, branch string, n_results long, error string", [
    (1, 0, "YouTube", 3, None), (1, 1, "Wikipedia", 2, None), (1, 2, "Suggestions", 1, None), (2, 0, "YouTube", None, "no key"), (2, 1, "Wikipedia", 1, None), (2, 2, "Suggestions", None, "timeout"), (3, 0, "YouTube", 0, None), (3, 1, "Wikipedia", 0, None),
])


@query(
    "resource_branches",
    f"""SELECT request, coalesce(string_agg(branch, '|' ORDER BY ord) FILTER (WHERE error IS NULL AND n_results > 0), '') AS found,
coalesce(string_agg(CASE WHEN error IS NOT NULL THEN branch || ': ' || error ELSE {text(R.NO_VIDEOS)} END, '|' ORDER BY ord) FILTER (WHERE error IS NOT NULL OR (branch = 'YouTube' AND n_results = 0)), '') AS warnings FROM {BRANCHES.sql} GROUP BY request""",
)
def resource_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resources(BRANCHES.spark(spark)).select("request", F.array_join("found", "|").alias("found"), F.array_join("warnings", "|").alias("warnings"))


_FLAT = "regexp_replace(text, '\\n+', ' ', 'g')"


@query(
    "summary_baselines",
    f"""WITH b AS (SELECT doc_id, list_filter({sentences_sql(_FLAT)}, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 5) AS b FROM {TEXTS}),
s AS (SELECT doc_id, b, unnest(b) AS x, unnest(range(len(b))) AS i FROM b), d AS (SELECT s.doc_id, draw, x, i FROM s, (SELECT unnest(range(1, 4)) AS draw)
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, draw ORDER BY md5('7:' || draw || ':' || s.doc_id || ':' || i), i) <= {S.summary_sentences})
SELECT doc_id, 'lead' AS method, 0 AS draw, array_to_string(b[1:{S.summary_sentences}], ' ') AS summary FROM b WHERE len(b) > 0 UNION ALL SELECT doc_id, 'random', draw, string_agg(x, ' ' ORDER BY i) FROM d GROUP BY doc_id, draw""",
)
def summary_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _texts(spark, sf_dir).select("doc_id", T.sentences(F.regexp_replace("text", "\n+", " ")).alias("sentences"))
    return E.baseline_summaries(body, draws=3)


VARIANTS = Inline("variant string, answerable boolean, failed boolean, fact_recall double, rouge_l double, abstained boolean", [
    ("with", True, False, 1.0, 0.5, False), ("with", True, False, 0.5, 0.25, False), ("with", True, True, 0.0, 0.0, False), ("with", False, False, None, None, True), ("no", True, False, 0.25, 0.1, False), ("no", False, False, None, None, False), ("no", False, False, None, None, True),
])


@query(
    "answer_variants",
    f"""SELECT variant, count(*) FILTER (WHERE answerable) AS n_answerable, round(avg(fact_recall) FILTER (WHERE answerable), 6) AS fact_recall, round(avg(rouge_l) FILTER (WHERE answerable), 6) AS rouge_l,
count(*) FILTER (WHERE NOT answerable) AS n_unanswerable, round(avg(abstained::INTEGER) FILTER (WHERE NOT answerable), 6) AS abstained FROM {VARIANTS.sql} WHERE NOT failed GROUP BY variant""",
)
def answer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.answer_variants(VARIANTS.spark(spark))
    return out.select("variant", "n_answerable", F.round("fact_recall", 6).alias("fact_recall"), F.round("rouge_l", 6).alias("rouge_l"), "n_unanswerable", F.round("abstained", 6).alias("abstained"))


COSTS = Inline("doc_id long, term string, cost double", [(1, "a", 0.1), (1, "b", 0.4), (2, "c", 0.0)])


@query("kw_inverted_costs", f"SELECT doc_id, term, round(1 - cost / CASE WHEN max(cost) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE max(cost) OVER (PARTITION BY doc_id) END, 6) AS score FROM {COSTS.sql}")
def kw_inverted_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.inverted_costs(COSTS.spark(spark)).withColumn("score", F.round("score", 6))


@query("embed_fallback", f"{CHUNKS}, {tfidf_sql('chunk', 'position', False, True).replace('<= 2000', '<= 512')} SELECT doc_id, part, term, round(weight, 6) AS weight FROM tfidf")
def embed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks for want of an embedder."""
    texts = T.document_chunks(_texts(spark, sf_dir)).select("doc_id", F.transform("chunks", lambda c: c["text"]).alias("texts"))
    vectors, _, _ = K.embed(texts)
    return vectors.withColumn("weight", F.round("weight", 6))


@query(
    "analyze_documents",
    f"""{_IMP}, best AS (SELECT doc_id, count(*) AS n_sentences, max(score) AS best_score FROM imp GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n_chunks FROM chunk GROUP BY doc_id)
SELECT doc_id, n_chunks, n_sentences, least(n_sentences, {S.summary_sentences}) AS n_summary, best_score FROM c JOIN best USING (doc_id)""",
)
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a whole analysis; its tables share one pass over the documents."""
    a = AN.analyze(_texts(spark, sf_dir))
    best = a.sentence_importance.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max("score").alias("best_score"))
    sizes = [a.chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), a.summary.groupBy("doc_id").agg(F.count("*").alias("n_summary"))]
    return best.join(sizes[0], "doc_id").join(sizes[1], "doc_id").select("doc_id", "n_chunks", "n_sentences", "n_summary", "best_score")
