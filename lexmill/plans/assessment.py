"""Queries on question pools, grading and weak areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..operators import assess as A
from .catalog import BOOK_SQL, book_of, query, table
from .dialogue import with_items
from .duck import Inline, content_stems, text

#: The sources of documents as books of chunks; quality labels as importance, languages but one as topics.
FX_CHUNKS = Inline("doc_id string, chunk_id string, position long", [("fx", f"c{i}", i) for i in range(10)] + [("bare", f"c{i}", i) for i in range(7)] + [("one", "c0", 0)])
FX_IMP = Inline("doc_id string, chunk_id string, importance double", [("fx", f"c{i}", v) for i, v in ((0, 0.1), (1, 0.9), (2, 0.2), (3, 0.3), (5, 0.8), (7, 0.6), (8, 0.7))])
FX_TOPICS = Inline("doc_id string, ord long, topic_id string, label string, size long, chunk_ids array<string>", [
    ("fx", 0, "t0", "a, b", 3, ["c0", "c1", "c2"]), ("fx", 1, "t1", "c", 4, ["c3", "c4", "c5", "c6"]), ("fx", 2, "t2", "d", 2, ["c8", "c1"]),
])
CHUNKS = f"(SELECT * FROM {FX_CHUNKS.sql} UNION ALL SELECT {BOOK_SQL}, 'd' || doc_id, doc_id FROM documents)"
IMP = f"(SELECT * FROM {FX_IMP.sql} UNION ALL SELECT {BOOK_SQL}, 'd' || doc_id, max(quality + toxic / 4::DOUBLE) FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"
_LANGS = f"(SELECT book AS doc_id, row_number() OVER (PARTITION BY book ORDER BY lang) - 1 AS ord, lang AS topic_id, 'in ' || lang AS label, count(*) AS size, list('d' || doc_id ORDER BY doc_id) AS chunk_ids FROM (SELECT {BOOK_SQL} AS book, * FROM documents) WHERE lang <> 'es' GROUP BY book, lang)"
TOPICS = f"(SELECT * FROM {FX_TOPICS.sql} UNION ALL SELECT * FROM {_LANGS})"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(book_of().alias("doc_id"), F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("doc_id").alias("position"))
    return FX_CHUNKS.spark(spark).unionByName(docs)


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    worth = rows.groupBy(book_of().alias("doc_id"), F.concat(F.lit("d"), "doc_id").alias("chunk_id")).agg(F.max(F.col("quality") + F.col("toxic") / 4).alias("importance"))
    return FX_IMP.spark(spark).unionByName(worth)


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").where("lang <> 'es'").withColumn("book", book_of()).groupBy("book", "lang").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    ord_ = (F.row_number().over(Window.partitionBy("book").orderBy("lang")) - 1).cast("long")
    names = F.transform("ids", lambda i: F.concat(F.lit("d"), i))
    rows = docs.select(F.col("book").alias("doc_id"), ord_.alias("ord"), F.col("lang").alias("topic_id"), F.concat(F.lit("in "), "lang").alias("label"), "size", names.alias("chunk_ids"))
    return FX_TOPICS.spark(spark).unionByName(rows)


_POOL = f"least({S.pool_cap}, greatest(3, ceil(5 / 2::DOUBLE) + 1))"
_SIZED = f"s AS (SELECT *, least({_POOL}, count(*) OVER (PARTITION BY doc_id))::BIGINT AS n, count(*) OVER (PARTITION BY doc_id) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS i FROM {CHUNKS})"
_EVEN = "even AS (SELECT DISTINCT doc_id, chunk_id, position FROM s, LATERAL (SELECT unnest(range(n)) AS j) WHERE floor(j * len / n::DOUBLE) = i)"


@query("question_pool_even", f"WITH {_SIZED}, {_EVEN} SELECT doc_id, chunk_id, position FROM even")
def question_pool_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evenly_spaced(_chunks(spark, sf_dir), 5)


@query(
    "question_pool_exam",
    f"""WITH {_SIZED}, {_EVEN}, r AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(importance, 0) DESC, position) AS r FROM s LEFT JOIN {IMP} USING (doc_id, chunk_id))
SELECT doc_id, chunk_id, position FROM r WHERE r <= n AND doc_id IN (SELECT doc_id FROM {IMP}) UNION ALL SELECT * FROM even WHERE doc_id NOT IN (SELECT doc_id FROM {IMP})""",
)
def question_pool_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exam_pool(_chunks(spark, sf_dir), _importance(spark, sf_dir), 5)


_KNOW = f"""WITH {_SIZED}, {_EVEN}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS k FROM {TOPICS}),
own AS (SELECT doc_id, chunk_id, min(k) AS k FROM (SELECT doc_id, k, unnest(chunk_ids) AS chunk_id FROM t) GROUP BY ALL),
a AS (SELECT s.*, coalesce(importance, 0) AS imp, k, CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, k ORDER BY coalesce(importance, 0) DESC, position) END AS turn FROM s LEFT JOIN {IMP} USING (doc_id, chunk_id) LEFT JOIN own USING (doc_id, chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k IS NULL, turn, k, imp DESC, position) AS r FROM a),
pool AS (SELECT doc_id, chunk_id, position FROM r WHERE r <= n AND doc_id IN (SELECT doc_id FROM t) UNION ALL SELECT * FROM even WHERE doc_id NOT IN (SELECT doc_id FROM t))"""


@query(
    "question_pool_knowledge",
    f"""{_KNOW}, f AS (SELECT doc_id, chunk_id, arg_min(topic_id, ord) AS topic_id, arg_min(label, ord) AS topic FROM (SELECT doc_id, ord, topic_id, label, unnest(chunk_ids) AS chunk_id FROM {TOPICS}) GROUP BY ALL)
SELECT doc_id, chunk_id, position, position + 1 AS label, topic_id, coalesce(topic, 'General') AS topic_label FROM pool LEFT JOIN f USING (doc_id, chunk_id)""",
)
def question_pool_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _topics(spark, sf_dir)
    return A.with_topics(A.knowledge_pool(_chunks(spark, sf_dir), _importance(spark, sf_dir), topics, 5), topics)


SIZES = Inline("asked long, available long", [(1, 20), (10, 20), (20, 20), (20, 4), (5, 0), (7, 5)])


@query("pool_sizes", f"SELECT asked, available, least(least({S.pool_cap}, greatest(3, ceil(asked / 2::DOUBLE) + 1)), available)::BIGINT AS n FROM {SIZES.sql}")
def pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIZES.spark(spark).select("asked", "available", A.pool_size(F.col("asked"), F.col("available")).alias("n"))


ASKS = Inline("id long, message string", list(enumerate(("quiz me with 8 hard multiple choice questions", "ten easy essay questions", "test me", "500 questions please", "give me 0 questions", "twenty one MCQs, challenging", "three basic short-answer items, then explain", "12345 of them", None), 1)))
_M = "lower(coalesce(message, ''))"
_NUM = f"regexp_extract({_M}, '\\b(\\d{{1,4}})\\b', 1)"
_WORDNUM = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({_M}, '\\b{w}\\b') THEN {n} END" for w, n in A.NUMBER_WORDS.items()) + f", {S.default_questions})"
_COUNT = f"CASE WHEN {_NUM} <> '' THEN try_cast({_NUM} AS INTEGER) ELSE {_WORDNUM} END"


@query(
    "parse_requests",
    f"""SELECT id, least({S.max_questions}, CASE WHEN {_COUNT} < 1 THEN {S.default_questions} ELSE {_COUNT} END)::BIGINT AS count, CASE WHEN regexp_matches({_M}, {text(A.EASY)}) THEN 'easy' WHEN regexp_matches({_M}, {text(A.HARD)}) THEN 'hard' ELSE 'medium' END AS difficulty,
CASE WHEN regexp_matches({_M}, {text(A.MCQ)}) THEN 'mcq' WHEN regexp_matches({_M}, {text(A.SHORT)}) THEN 'short' ELSE 'mixed' END AS type FROM (SELECT id, message FROM {ASKS.sql} UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations)""",
)
def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.col("text").alias("message"))
    return ASKS.spark(spark).unionByName(talk).select("id", *[c.alias(n) for n, c in A.parse_request(F.col("message")).items()])


_OPTS = ["red", "Green", "  blue ", "dark  red"]
CHOICES = Inline("id long, response string, options array<string>, answer string", [(i, r, _OPTS, "Green") for i, r in enumerate(("C", "Option D", "b) green", "  BLUE ", "purple", "(a)", "f", "Green", "option  b", "", "B.", "d: dark red", "Dark Red"))])
_SAME = "regexp_replace(lower(trim({})), '\\s+', ' ', 'g')"


def _resolve(answer: str, options: str) -> str:
    a = f"trim({answer})"
    letter = f"upper(regexp_extract({a}, {text(A.LETTER)}, 1) || regexp_extract({a}, {text(A.OPTION)}, 1))"
    bare = f"trim(regexp_replace({a}, '(?i)^\\s*\\(?[a-f][).:]\\s+', ''))"
    exact = f"list_filter({options}, lambda o: {_SAME.format('o')} = {_SAME.format(a)} OR {_SAME.format('o')} = {_SAME.format(bare)})[1]"
    return f"CASE WHEN {letter} <> '' THEN ({options})[ascii({letter}) - 64] ELSE {exact} END"


@query("mcq_resolve", f"SELECT id, {_resolve('response', 'options')} AS resolved, CASE WHEN coalesce({_resolve('response', 'options')} = answer, false) THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM {CHOICES.sql}")
def mcq_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return CHOICES.spark(spark).select("id", A.resolve_choice(c("response"), c("options")).alias("resolved"), A.grade_choice(c("response"), c("options"), c("answer")).alias("score"))


SHORTS = Inline("id long, answer string, response string", [(1, "Chlorophyll absorbs light energy for photosynthesis", "chlorophyll absorbing light energies in photosynthesis"), (2, "Chlorophyll absorbs light energy for photosynthesis", "It absorbs light"), (3, "x y", "I do not know"), (4, "the of", "the"), (5, "water", None)])
_PAIRS = f"(SELECT id, answer, response FROM {SHORTS.sql} UNION ALL SELECT 1000 + d.doc_id, b.text, d.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
_KEY, _GIVEN = f"list_distinct({content_stems('answer')})", f"list_distinct({content_stems('''coalesce(response, '')''')})"
_SHORT = f"""WITH k AS (SELECT id, {content_stems('answer')} AS ks, {_GIVEN} AS given FROM {_PAIRS}),
d AS (SELECT id, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS key, given FROM k),
c AS (SELECT *, CASE WHEN len(key) > 0 AND len(given) > 0 THEN len(list_filter(key, lambda x: list_contains(given, x))) / len(key)::DOUBLE ELSE 0::DOUBLE END AS share FROM d)"""


@query(
    "grade_short",
    f"""{_SHORT} SELECT id, CASE WHEN share >= {S.short_correct} THEN 1::DOUBLE WHEN share >= {S.short_partial} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score, share >= {S.short_correct} AS correct, floor(share * 100 + 0.5::DOUBLE) / 100 AS coverage,
array_to_string(list_filter(key, lambda x: NOT list_contains(given, x))[1:8], ',') AS missing FROM c""",
)
def grade_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_items(spark, sf_dir).select((F.col("doc_id") + 1000).alias("id"), F.col("item").alias("answer"), F.col("text").alias("response"))
    told = SHORTS.spark(spark).unionByName(rows)
    g = A.grade_short(F.col("response"), F.col("answer"))
    return told.select("id", g["score"].alias("score"), g["correct"].alias("correct"), g["coverage"].alias("coverage"), F.array_join(g["missing"], ",").alias("missing"))


QUESTIONS = Inline("quiz_id string, qid string, ord long, type string, options array<string>, answer string, topic_id string, topic_label string", [
    ("q", "a", 1, "mcq", ["red", "green"], "green", "A", "Alpha"), ("q", "b", 2, "short", [], "water moves through membranes", "B", "Beta"), ("q", "c", 3, "mcq", ["x", "y"], "x", "A", "Alpha renamed"), ("r", "z", 1, "mcq", ["x", "y"], "y", None, None),
])
RESPONSES = Inline("attempt_id long, qid string, ord long, response string", [(1, "a", 1, "red"), (1, "a", 2, "B"), (1, "zz", 3, "x"), (1, "b", 4, "water moves"), (2, "z", 1, "b"), (3, "b", 1, "membrane")])
ATTEMPTS = Inline("attempt_id long, quiz_id string", [(1, "q"), (2, "r"), (3, "q"), (4, "none")])
_ITEMS = f"""WITH last AS (SELECT attempt_id, qid, arg_max(response, ord) AS response FROM {RESPONSES.sql} GROUP BY ALL),
j AS (SELECT a.attempt_id, q.* EXCLUDE (quiz_id), coalesce(l.response, '') AS response FROM {ATTEMPTS.sql} a JOIN {QUESTIONS.sql} q USING (quiz_id) LEFT JOIN last l ON l.attempt_id = a.attempt_id AND l.qid = q.qid),
k AS (SELECT *, {_KEY} AS key, {_GIVEN} AS given FROM j),
c AS (SELECT *, CASE WHEN len(key) > 0 AND len(given) > 0 THEN len(list_filter(key, lambda x: list_contains(given, x))) / len(key)::DOUBLE ELSE 0::DOUBLE END AS share FROM k),
items AS (SELECT attempt_id, qid, ord, response, coalesce(topic_id, 'general') AS topic_id, coalesce(topic_label, 'General') AS topic_label, CASE WHEN type = 'mcq' THEN CASE WHEN coalesce({_resolve('response', 'options')} = answer, false) THEN 1::DOUBLE ELSE 0::DOUBLE END WHEN share >= {S.short_correct} THEN 1::DOUBLE WHEN share >= {S.short_partial} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score FROM c)"""


def _items(spark: SparkSession) -> DataFrame:
    return A.grade_attempts(QUESTIONS.spark(spark), RESPONSES.spark(spark), ATTEMPTS.spark(spark))


@query("grade_attempt", f"{_ITEMS} SELECT attempt_id, qid, response, topic_id, topic_label, score FROM items")
def grade_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark).drop("ord")


@query("attempt_totals", f"{_ITEMS} SELECT attempt_id, floor(sum(score) * 100 + 0.5::DOUBLE) / 100 AS score, count(*) AS total, floor(sum(score) / count(*) * 100 + 0.5::DOUBLE)::BIGINT AS percent FROM items GROUP BY attempt_id")
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attempt_totals(_items(spark))


@query("topic_totals", f"{_ITEMS} SELECT attempt_id, topic_id, arg_min(topic_label, ord) AS label, floor(sum(score) * 100 + 0.5::DOUBLE) / 100 AS earned, count(*) AS total, floor(sum(score) / count(*) * 100 + 0.5::DOUBLE)::BIGINT AS percent FROM items GROUP BY attempt_id, topic_id")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topic_totals(_items(spark))


FX_ATTEMPTS = Inline("user_id long, topic_id string, label string, created_at long, earned double, total long", [(-1, "A", "Old name", 1, 0.5, 2), (-1, "A", "New name", 2, 0.0, 0), (-1, "B", "Beta", 1, 2.0, 2), (-1, "C", "Close", 1, 149.0, 250), (-1, "D", "None", 1, 0.0, 0)])
_WEAK = f"(SELECT * FROM {FX_ATTEMPTS.sql} UNION ALL SELECT user_id, event_type, event_type || ' v' || (event_id % 3), event_id, least(1, value / 100), 1 FROM events)"


@query(
    "weak_areas",
    f"""WITH s AS (SELECT user_id, topic_id, arg_max(label, created_at) AS label, sum(earned) AS earned, sum(total)::BIGINT AS total FROM {_WEAK} GROUP BY ALL), r AS (SELECT *, CASE WHEN total > 0 THEN earned / total ELSE 0 END AS ratio FROM s)
SELECT user_id, topic_id, label, round(earned, 6) AS earned, total, floor(round(ratio * 100, 9) + 0.5::DOUBLE)::BIGINT AS percent, round(ratio, 9) < {S.weak_threshold}::DOUBLE AS weak, floor(round(ratio * 100, 9) + 0.5::DOUBLE) < {S.weak_threshold * 100} AS weak_by_percent FROM r""",
)
def weak_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event values as earned shares of one point each."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("topic_id"), F.concat("event_type", F.lit(" v"), (F.col("event_id") % 3).cast("string")).alias("label"),
        F.col("event_id").alias("created_at"), F.least(F.lit(1.0), F.col("value") / 100).alias("earned"), F.lit(1).cast("long").alias("total"),
    )
    return A.weak_areas(FX_ATTEMPTS.spark(spark).unionByName(events))


SETS = Inline("set_id long, body string", [
    (1, '```json\n{"questions": [{"question": "What is water?", "options": ["a", "b"], "answer": "B", "explanation": "because", "sourceChunk": 2}, {"question": "short", "answer": "x", "explanation": "because"}]}\n```'),
    (2, '[{"question": "Name a colour now", "answer": "red", "explanation": "it is", "sourceChunk": 9}]'), (3, "no json"), (4, '[{"question": "Pick one of these", "options": ["a", "A "], "answer": "a", "explanation": "dup"}]'),
])


@query("question_sets", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, true, 'What is water?', 'b', 2), (2, 1, true, 'Name a colour now', 'red', NULL), (3, 0, false, NULL, NULL, NULL), (4, 0, false, NULL, NULL, NULL)) t(set_id, n_valid, accepted, question, answer, source)")
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.valid_questions(SETS.spark(spark), "body", 1, F.array(F.lit(1), F.lit(2)))
    first = F.get("questions", F.lit(0))
    return out.select("set_id", "n_valid", "accepted", first["question"].alias("question"), first["answer"].alias("answer"), first["source"].alias("source"))


@query("client_view", f"SELECT quiz_id, qid, type, CASE WHEN quiz_id = 'q' THEN answer END AS answer FROM {QUESTIONS.sql}")
def client_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QUESTIONS.spark(spark).withColumn("question", F.lit("?")).withColumn("explanation", F.lit("!"))
    return A.client_view(rows, F.when(F.col("quiz_id") == "q", "practice").otherwise("quiz")).select("quiz_id", "qid", "type", "answer")
