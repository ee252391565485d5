"""Assessment: question pools, answer resolution, grading and weak areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.lexical import content_stems, round_half_up

#: Number words in their order of precedence.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20}
EASY, HARD = r"\b(easy|beginner|simple|basic)\b", r"\b(hard|difficult|challenging|advanced|tough)\b"
MCQ, SHORT = r"\b(mcqs?|multiple[- ]choice)\b", r"\b(short[- ]answer|written|essay|viva|long[- ]answer|explain)\b"
LETTER = r"(?i)^\(?([a-f])[).:]?\)?$"
OPTION = r"(?i)^option\s+([a-f])$"


def pool_size(count: Column, available: Column, s: Settings = SETTINGS) -> Column:
    return F.least(F.least(F.lit(s.pool_cap), F.greatest(F.lit(3), F.ceil(count / 2) + 1)), available).cast("long")


def first_topics(topics: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, topic_id, label): of several topics of a chunk the first in order wins."""
    members = topics.select("doc_id", "ord", "topic_id", "label", F.explode("chunk_ids").alias("chunk_id"))
    first = members.groupBy("doc_id", "chunk_id").agg(F.min_by(F.struct("topic_id", "label"), "ord").alias("t"))
    return first.select("doc_id", "chunk_id", "t.topic_id", "t.label")


def _sized(chunks: DataFrame, count: int, s: Settings) -> DataFrame:
    have = F.count("*").over(Window.partitionBy("doc_id"))
    return chunks.withColumn("_n", pool_size(F.lit(count), have, s)).withColumn("_len", have)


def evenly_spaced(chunks: DataFrame, count: int, s: Settings = SETTINGS) -> DataFrame:
    """Every (length / n)-th chunk of each document by position."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    sized = _sized(chunks, count, s).withColumn("_i", rank)
    # Index i is taken if some j < n has floor(j * len / n) = i: the least such j is ceil(i * n / len).
    j = F.ceil(F.col("_i") * F.col("_n") / F.col("_len"))
    return sized.where((j < F.col("_n")) & (F.floor(j * F.col("_len") / F.col("_n")) == F.col("_i"))).select(*chunks.columns)


def exam_pool(chunks: DataFrame, importance: DataFrame, count: int, s: Settings = SETTINGS) -> DataFrame:
    """The most important chunks of each document; documents without any importance are spaced evenly."""
    scored = _sized(chunks, count, s).join(importance, ["doc_id", "chunk_id"], "left")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "position"))
    known = F.max(F.col("importance").isNotNull()).over(Window.partitionBy("doc_id"))
    top = scored.withColumn("_r", rank).withColumn("_k", known)
    spaced = evenly_spaced(chunks.join(importance.select("doc_id").distinct(), "doc_id", "left_anti"), count, s)
    return top.where(F.col("_k") & (F.col("_r") <= F.col("_n"))).select(*chunks.columns).unionByName(spaced)


def knowledge_pool(chunks: DataFrame, importance: DataFrame, topics: DataFrame, count: int, s: Settings = SETTINGS) -> DataFrame:
    """Spread over topics: the best chunk of each topic in order of size, then the second best of
    each, and so on; chunks of no topic fill up.  Documents without topics are spaced evenly."""
    of = topics.select("doc_id", "ord", "size", F.explode("chunk_ids").alias("chunk_id"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("size"), "ord")
    ranked = topics.select("doc_id", "ord", F.row_number().over(order).alias("_topic"))
    owner = of.join(ranked, ["doc_id", "ord"]).groupBy("doc_id", "chunk_id").agg(F.min("_topic").alias("_topic"))
    scored = _sized(chunks, count, s).join(importance, ["doc_id", "chunk_id"], "left").join(owner, ["doc_id", "chunk_id"], "left")
    best = [F.desc(F.coalesce("importance", F.lit(0.0))), F.col("position")]
    turn = F.row_number().over(Window.partitionBy("doc_id", "_topic").orderBy(*best))
    # A round is the turn within a topic; what has no topic comes after all rounds, best first.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("_topic").isNull(), F.when(F.col("_topic").isNotNull(), F.col("_turn")), "_topic", *best))
    top = scored.withColumn("_turn", turn).withColumn("_r", rank)
    have = topics.select("doc_id").distinct()
    spaced = evenly_spaced(chunks.join(have, "doc_id", "left_anti"), count, s)
    return top.join(have, "doc_id", "left_semi").where(F.col("_r") <= F.col("_n")).select(*chunks.columns).unionByName(spaced)


def with_topics(pool: DataFrame, topics: DataFrame) -> DataFrame:
    """The pool with 1-based labels and topic names; chunks of no topic are General."""
    named = pool.join(first_topics(topics), ["doc_id", "chunk_id"], "left")
    return named.select("doc_id", "chunk_id", "position", (F.col("position") + 1).alias("label"), "topic_id", F.coalesce(named["label"], F.lit("General")).alias("topic_label"))


def parse_request(message: Column, s: Settings = SETTINGS) -> dict[str, Column]:
    """count, difficulty and type asked for in a message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    number = F.regexp_extract(m, r"\b(\d{1,4})\b", 1)
    words = F.coalesce(*[F.when(m.rlike(rf"\b{w}\b"), F.lit(n)) for w, n in NUMBER_WORDS.items()], F.lit(s.default_questions))
    count = F.when(number != "", number.try_cast("int")).otherwise(words)
    count = F.least(F.lit(s.max_questions), F.when(count < 1, s.default_questions).otherwise(count))
    return {
        "count": count.cast("long"),
        "difficulty": F.when(m.rlike(EASY), "easy").when(m.rlike(HARD), "hard").otherwise("medium"),
        "type": F.when(m.rlike(MCQ), "mcq").when(m.rlike(SHORT), "short").otherwise("mixed"),
    }


def _same(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def resolve_choice(answer: Column, options: Column) -> Column:
    """The option meant by a letter, "option X", "b) text" or the text itself; letters win; else null."""
    a = F.trim(answer)
    letter = F.upper(F.concat(F.regexp_extract(a, LETTER, 1), F.regexp_extract(a, OPTION, 1)))
    bare = F.trim(F.regexp_replace(a, r"(?i)^\s*\(?[a-f][).:]\s+", ""))
    exact = F.filter(options, lambda o: (_same(o) == _same(a)) | (_same(o) == _same(bare)))
    return F.when(letter != "", F.get(options, F.ascii(letter) - 65)).otherwise(F.get(exact, F.lit(0)))


def grade_choice(response: Column, options: Column, answer: Column) -> Column:
    return F.when(F.coalesce(resolve_choice(F.coalesce(response, F.lit("")), options) == answer, F.lit(False)), 1.0).otherwise(0.0)


def grade_short(response: Column, answer: Column, s: Settings = SETTINGS) -> dict[str, Column]:
    """score, correct, coverage and up to eight missing terms, by the answer's distinct content stems."""
    key, given = F.array_distinct(content_stems(answer)), F.array_distinct(content_stems(F.coalesce(response, F.lit(""))))
    usable = (F.size(key) > 0) & (F.size(given) > 0)
    share = F.when(usable, F.size(F.array_intersect(key, given)) / F.size(key)).otherwise(0.0)
    score = F.when(share >= s.short_correct, 1.0).when(share >= s.short_partial, 0.5).otherwise(0.0)
    return {"score": score, "correct": share >= s.short_correct, "coverage": round_half_up(share * 100) / 100, "missing": F.slice(F.array_except(key, given), 1, 8)}


def grade_attempts(questions: DataFrame, responses: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per attempt and question of its quiz; the last of several responses counts, unknown
    question ids are ignored, a missing response is empty and scores 0."""
    last = responses.groupBy("attempt_id", "qid").agg(F.max_by("response", "ord").alias("response"))
    rows = attempts.join(questions, "quiz_id").join(last, ["attempt_id", "qid"], "left").withColumn("response", F.coalesce("response", F.lit("")))
    score = F.when(F.col("type") == "mcq", grade_choice(F.col("response"), F.col("options"), F.col("answer"))).otherwise(grade_short(F.col("response"), F.col("answer"))["score"])
    return rows.select("attempt_id", "qid", "ord", "response", F.coalesce("topic_id", F.lit("general")).alias("topic_id"), F.coalesce("topic_label", F.lit("General")).alias("topic_label"), score.alias("score"))


def attempt_totals(items: DataFrame) -> DataFrame:
    score = round_half_up(F.sum("score") * 100) / 100
    return items.groupBy("attempt_id").agg(score.alias("score"), F.count("*").alias("total"), round_half_up(F.sum("score") / F.count("*") * 100).alias("percent"))


def topic_totals(items: DataFrame) -> DataFrame:
    """(attempt_id, topic_id, label, earned, total, percent); a topic is named as at its first question."""
    return items.groupBy("attempt_id", "topic_id").agg(
        F.min_by("topic_label", "ord").alias("label"), (round_half_up(F.sum("score") * 100) / 100).alias("earned"), F.count("*").alias("total"), round_half_up(F.sum("score") / F.count("*") * 100).alias("percent")
    )


def weak_areas(rows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(user_id, topic_id, label, earned, total, percent, weak, weak_by_percent) over all attempts.

    ``weak`` tests the ratio itself, ``weak_by_percent`` the rounded percentage; they differ just
    below the threshold.  The label is the newest attempt's.
    """
    sums = rows.groupBy("user_id", "topic_id").agg(F.max_by("label", "created_at").alias("label"), F.sum("earned").alias("earned"), F.sum("total").alias("total"))
    ratio = F.when(F.col("total") > 0, F.col("earned") / F.col("total")).otherwise(0.0)
    percent = round_half_up(F.round(ratio * 100, 9))
    return sums.select("user_id", "topic_id", "label", F.round("earned", 6).alias("earned"), "total", percent.alias("percent"), (F.round(ratio, 9) < s.weak_threshold).alias("weak"), (percent < s.weak_threshold * 100).alias("weak_by_percent"))


def valid_questions(rows: DataFrame, json: str, count: int, labels: Column, kind: str = "mixed") -> DataFrame:
    """(set_id, questions, n_valid, accepted): question sets parsed from JSON text and checked.

    A question needs 8 characters, an answer and an explanation of 3; choices need 2 to 6 distinct
    options with the answer among them; an unknown source becomes null.  A set is accepted with at
    least 60 % of ``count`` valid questions and cut to ``count``.
    """
    shape = "question string, options array<string>, answer string, explanation string, sourceChunk int"
    fence = F.regexp_replace(F.trim(json), r"(?s)^```(?:json)?\s*|\s*```$", "")
    bare = F.from_json(fence, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in shape.split(', '))}>>")
    held = F.from_json(fence, f"struct<questions:array<struct<{', '.join(f.replace(' ', ':', 1) for f in shape.split(', '))}>>>")
    items = F.coalesce(held["questions"], bare)

    def choice(q: Column) -> Column:
        o = F.transform(q["options"], lambda x: F.trim(x))
        return F.coalesce((F.size(o) >= 2) & (F.size(o) <= 6) & (F.size(F.array_distinct(F.transform(o, _same))) == F.size(o)) & resolve_choice(q["answer"], o).isNotNull(), F.lit(False))

    def good(q: Column) -> Column:
        base = (F.length(F.trim(q["question"])) >= 8) & (F.length(F.trim(q["answer"])) >= 1) & (F.length(F.trim(q["explanation"])) >= 3)
        asks = F.coalesce(F.size(q["options"]) > 0, F.lit(False))
        fit = choice(q) if kind == "mcq" else ~asks if kind == "short" else ~asks | choice(q)
        return F.coalesce(base & fit, F.lit(False))

    def clean(q: Column) -> Column:
        o = F.transform(q["options"], lambda x: F.trim(x))
        answer = F.when(F.coalesce(F.size(o) > 0, F.lit(False)), resolve_choice(q["answer"], o)).otherwise(F.trim(q["answer"]))
        source = F.when(F.array_contains(labels, q["sourceChunk"]), q["sourceChunk"])
        return F.struct(F.trim(q["question"]).alias("question"), o.alias("options"), answer.alias("answer"), source.alias("source"))

    valid = F.transform(F.filter(items, good), clean)
    told = rows.select("set_id", F.coalesce(valid, F.array().cast("array<struct<question:string,options:array<string>,answer:string,source:int>>")).alias("v"))
    least = -(-count * 6 // 10)
    return told.select("set_id", F.slice("v", 1, count).alias("questions"), F.size("v").cast("long").alias("n_valid"), (F.size("v") >= least).alias("accepted"))


def client_view(questions: DataFrame, kind: Column) -> DataFrame:
    """Questions as shown to a student: answers only in practice sets."""
    shown = kind == "practice"
    return questions.select("quiz_id", "qid", "type", "question", "options", F.when(shown, F.col("answer")).alias("answer"), F.when(shown, F.col("explanation")).alias("explanation"))


#: What a question set may ask for.
DIFFICULTIES, TYPES, MODES = ("easy", "medium", "hard"), ("mcq", "short", "mixed"), ("knowledge", "exam")


def question_options(count: Column, difficulty: Column, kind: Column, mode: Column, s: Settings = SETTINGS) -> dict[str, Column]:
    """count, difficulty, type and mode with their defaults, and error: why a request is refused.

    ``count`` is text, as requests have it; it is rounded half up.
    """
    n = F.floor(F.coalesce(count, F.lit("5")).try_cast("double") + 0.5)
    n = F.when(F.isnan(n), None).otherwise(n).cast("long")
    told = {"difficulty": F.coalesce(difficulty, F.lit("medium")), "type": F.coalesce(kind, F.lit("mixed")), "mode": F.coalesce(mode, F.lit("knowledge"))}
    error = F.when(n.isNull() | (n < 1) | (n > s.max_questions), F.lit(f"count must be an integer between 1 and {s.max_questions}"))
    for name, allowed in (("difficulty", DIFFICULTIES), ("type", TYPES), ("mode", MODES)):
        error = error.when(~told[name].isin(*allowed), F.lit(f"{name} must be one of: {', '.join(allowed)}"))
    return {"count": n, **told, "error": error}


def with_sources(questions: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """Questions (doc_id, qid, source) with the chunk that ``labels`` (doc_id, label, chunk_id) names
    as their source and that chunk's topic; without one the topic is General."""
    chunk = questions.join(labels.select("doc_id", F.col("label").alias("source"), "chunk_id"), ["doc_id", "source"], "left")
    named = chunk.join(first_topics(topics), ["doc_id", "chunk_id"], "left")
    return named.select("doc_id", "qid", "source", "chunk_id", "topic_id", F.coalesce("label", F.lit("General")).alias("topic_label"))


def attempt_review(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Graded items of attempts with the answers revealed."""
    return items.select("attempt_id", "quiz_id", "qid", "response", "score").join(questions.select("quiz_id", "qid", "ord", "answer", "explanation"), ["quiz_id", "qid"])


def attempt_listing(attempts: DataFrame, user: str = "user_id", quiz: str = "quiz_id", created: str = "created_at") -> DataFrame:
    """Attempts of each user and quiz with ``n``, their number from the newest on."""
    order = Window.partitionBy(user, quiz).orderBy(F.desc(created), F.desc("attempt_id"))
    return attempts.withColumn("n", F.row_number().over(order).cast("long"))
