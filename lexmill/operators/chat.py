"""Conversation operators: follow-ups, query rewriting, history, citations, search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings

INSUFFICIENT = "[[INSUFFICIENT_CONTEXT]]"
#: Words without a topic of their own, and what marks a reference back.
TOPICLESS = tuple(
    """
    a an the and or but so if then also of to in on at by for from with about into as is are was were be been am do does did
    dont don't doesnt doesn't didnt didn't not no yes ok okay i me my we you your it its this that these those they them their
    there here what which who how why when where can could would should will please pls just really still very much more less
    again once another other one ones same understand understood get got getting follow followed grasp see confusing confused
    confuse unclear clear explain explained explaining simpler simply simple easier easy mean means meant tell say said show
    step steps way words word example examples elaborate clarify rephrase repeat further deeper detail details thing things
    stuff mixing
    """.split()
)
ANAPHORA = r"(?i)\b(it|its|this|that|these|those|they|them|their|there|above|previous|earlier|former|latter|same)\b"
CONNECTIVE = r"(?i)^\s*(and|but|so|also|then|what about|how about)\b"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def content_word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.lower(text), "[^a-z0-9']+"), lambda w: (w != "") & ~w.isin(*TOPICLESS)))


def is_follow_up(text: Column) -> Column:
    words = word_count(text)
    back = text.rlike(ANAPHORA) | text.rlike(CONNECTIVE)
    return (words > 0) & ((content_word_count(text) == 0) | ((words <= 8) & back))


def rewritten(messages: DataFrame, session: str, seq: str, role: str, content: str) -> DataFrame:
    """User messages with retrieval_query: a follow-up borrows the last user message before it."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(role) == "user", F.trim(content)), ignorenulls=True).over(w)
    now = F.trim(content)
    full = F.when(is_follow_up(now) & F.col("_last").isNotNull(), F.concat_ws(" ", F.col("_last"), now)).otherwise(now)
    return messages.withColumn("_last", last).where(F.col(role) == "user").withColumn("retrieval_query", full).drop("_last")


def history(messages: DataFrame, session: str, seq: str, role: str, content: str, s: Settings = SETTINGS) -> DataFrame:
    """User messages with the labelled history before each: the last messages of user and assistant."""
    spoken = messages.where(F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(-s.history_messages, -1)
    cut = F.when(F.length(content) > s.history_chars, F.concat(F.substring(content, 1, s.history_chars), F.lit("..."))).otherwise(F.col(content))
    line = F.concat(F.when(F.col(role) == "user", "Student").otherwise("Assistant"), F.lit(": "), cut)
    lines = F.collect_list(line).over(w)
    shown = F.when(F.size("_h") > 0, F.array_join("_h", "\n")).otherwise("(no previous messages)")
    return spoken.withColumn("_h", lines).where(F.col(role) == "user").withColumn("history", shown).drop("_h")


def citations(answer: Column) -> Column:
    """Distinct cited numbers, in order of first mention."""
    lists = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda n: F.trim(n).cast("long")))


def snippet(text: Column, chars: int = SETTINGS.snippet_chars) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars)), F.lit("..."))).otherwise(text)


def cited_sources(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, label, chunk_id, snippet, cited): the passages of an answer and which it cites."""
    told = answers.select("answer_id", citations(F.col("answer")).alias("_c"))
    label = (F.col("position") + 1).cast("long")
    return chunks.join(told, "answer_id").select("answer_id", label.alias("label"), "chunk_id", snippet(F.col("text")).alias("snippet"), F.array_contains("_c", label).alias("cited"))


def insufficient(answer: Column) -> tuple[Column, Column]:
    """Whether an answer says that its passages don't suffice, and the answer without the mark."""
    return F.contains(answer, F.lit(INSUFFICIENT)), F.trim(F.replace(answer, F.lit(INSUFFICIENT), F.lit("")))


def context_blocks(chunks: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """(key, context): numbered passages in order of rank, with their headings."""
    head = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" (Section: "), F.col("heading"), F.lit(")"))).otherwise("")
    block = F.concat(F.lit("["), (F.col("position") + 1).cast("string"), F.lit("]"), head, F.lit("\n"), F.trim("text"))
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("x"))
    return lists.select(key, F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("context"))


def session_listing(messages: DataFrame, session: str, seq: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("message_count"), F.max(seq).alias("last_seq"))


def search(messages: DataFrame, session: str, seq: str, content: str, term: str, per_session: int = 5, limit: int = 20) -> DataFrame:
    """Hits of a substring: the first few of each session, a fixed number in all (a search feature)."""
    at = F.instr(F.lower(content), term.lower())
    found = messages.withColumn("_at", at).where("_at > 0")
    rank = F.row_number().over(Window.partitionBy(session).orderBy(seq))
    top = found.withColumn("_r", rank).where(F.col("_r") <= per_session).orderBy(session, seq).limit(limit)
    return top.select(session, seq, F.substring(F.col(content), F.greatest(F.col("_at") - 30, F.lit(1)), F.lit(110)).alias("snippet"))


def resolve_mode(request: Column, session: Column) -> Column:
    return F.coalesce(request, session, F.lit("knowledge"))


_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render(template: str, values: dict[str, object]) -> str:
    """Fill ``{{name}}`` slots in one pass; a value is never expanded again, None is an empty text,
    a missing name is an error."""

    def fill(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(f"no value for {m[1]}")
        return "" if values[m[1]] is None else str(values[m[1]])

    return _SLOT.sub(fill, template)


def key_point_prompts(topics: DataFrame, summary: DataFrame, keywords: DataFrame, per_topic: int = 5, n_keywords: int = 15) -> DataFrame:
    """(doc_id, topic_id, sentences, keywords): up to five summary sentences of a topic's chunks, else
    the document's first three; and its best keywords."""
    members = topics.select("doc_id", "topic_id", F.explode("chunk_ids").alias("chunk_id"))
    own = members.join(summary, ["doc_id", "chunk_id"]).groupBy("doc_id", "topic_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, per_topic).alias("own"))
    first = summary.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, 3).alias("first"))
    words = keywords.where(F.col("rank") <= n_keywords).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    joined = topics.select("doc_id", "topic_id").join(own, ["doc_id", "topic_id"], "left").join(first, "doc_id", "left").join(words, "doc_id", "left")
    texts = F.transform(F.coalesce("own", "first"), lambda x: x["text"])
    return joined.select("doc_id", "topic_id", texts.alias("sentences"), F.transform("k", lambda x: x["term"]).alias("keywords"))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``render`` with columns as values: an expression of what stands around the slots and the values."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        if m[1] not in values:
            raise KeyError(f"no value for {m[1]}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


#: What an answerer is told about its passages.
NOTE_CLOSE = "The excerpts match the question closely."
NOTE_POOR = "Retrieval confidence is LOW - the excerpts may not answer the question. If they do not, start your reply with the insufficient-context token."
NOTE_EXAM = "Excerpts were re-ranked so the most exam-relevant come first."


def retrieval_note(sufficient: Column, mode: Column, reranked: Column) -> Column:
    return F.concat_ws(" ", F.when(sufficient, NOTE_CLOSE).otherwise(NOTE_POOR), F.when((mode == "exam") & reranked, NOTE_EXAM))


def topics_line(labels: Column) -> Column:
    named = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("(document not analyzed yet)")


#: What handles an intent; anything else is a question.
HANDLERS = {"question": "answer", "doubt": "answer", "quiz": "question_set", "practice": "question_set", "research": "research", "resources": "resources"}


def dispatched(intent: Column, error: Column) -> dict[str, Column]:
    """intent, handler and warning of a message; a router that failed leaves a question."""
    failed = error.isNotNull()
    kind = F.when(failed, "question").otherwise(intent)
    table = F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv])
    warning = F.when(failed, F.concat(F.lit("intent routing failed ("), error, F.lit("); treating the message as a question")))
    return {"intent": kind, "handler": F.coalesce(F.try_element_at(table, kind), F.lit(HANDLERS["question"])), "warning": warning}


_POINTS = "array<struct<topic:string,key_points:array<string>,important_terms:array<string>>>"


def key_points(replies: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc_id, ord, topic, key_points, important_terms, warnings): of the up to two ``replies``
    (doc_id, attempt, reply) of a document the first that has one entry of text lists for each of
    ``topics`` (doc_id, ord, label); without one, the labels with empty lists."""
    wanted = topics.groupBy("doc_id").agg(F.count("*").alias("n"))
    told = replies.where("attempt <= 2").join(wanted, "doc_id").withColumn("v", F.try_parse_json("reply")).withColumn("p", F.from_json("reply", _POINTS))
    kinds = lambda x: F.schema_of_variant(x)
    lists = F.forall("p", lambda x: x["topic"].isNotNull() & x["key_points"].isNotNull() & x["important_terms"].isNotNull() & F.forall(x["key_points"], lambda t: t.isNotNull()) & F.forall(x["important_terms"], lambda t: t.isNotNull()))
    fine = F.coalesce(F.col("v").isNotNull() & kinds(F.col("v")).startswith("ARRAY") & (F.size("p") == F.col("n")) & lists, F.lit(False))
    judged = told.withColumn("fine", fine)
    first = judged.groupBy("doc_id").agg(F.min_by("p", F.when(F.col("fine"), F.col("attempt"))).alias("p"), F.min(F.when(F.col("fine"), F.col("attempt"))).alias("won"), F.array_sort(F.collect_list(F.when(~F.col("fine"), F.col("attempt")))).alias("bad"))
    warned = F.transform(F.filter("bad", lambda a: F.col("won").isNull() | (a < F.col("won"))), lambda a: F.concat(F.lit("attempt "), a.cast("string"), F.lit(": invalid key-points shape")))
    rows = topics.join(first, "doc_id", "left").withColumn("x", F.when(F.col("won").isNotNull(), F.get("p", F.col("ord").cast("int"))))
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "ord", F.coalesce("x.topic", "label").alias("topic"), F.coalesce("x.key_points", none).alias("key_points"), F.coalesce("x.important_terms", none).alias("important_terms"), F.coalesce(warned, none).alias("warnings")
    )


def structured_result(tries: DataFrame, attempts: int = 2) -> DataFrame:
    """(request, provider, attempt, result, fell_back): which of the tries (request, prio, provider,
    attempt, error, valid, result) a request keeps.

    Providers are asked in order, each up to ``attempts`` times; a transport error ends a provider's
    turns, an invalid result asks it again.  The first valid result counts.
    """
    turns = Window.partitionBy("request", "prio").orderBy("attempt")
    broken = F.max(F.col("error").isNotNull().cast("int")).over(turns)
    live = tries.where(F.col("attempt") <= attempts).withColumn("_b", broken).where((F.col("_b") == 0) & F.col("valid"))
    best = live.groupBy("request").agg(F.min(F.struct("prio", "attempt", "provider", "result")).alias("b"))
    asked = tries.select("request").distinct()
    return asked.join(best, "request", "left").select("request", "b.provider", "b.attempt", "b.result", F.coalesce(F.col("b.prio") > 0, F.lit(False)).alias("fell_back"))


def search_everything(docs: DataFrame, messages: DataFrame, term: str, most_docs: int = 25, most_sessions: int = 5, limit: int = 20) -> DataFrame:
    """(kind, doc_id, title, snippet): titles that hold a term, and messages that do.

    ``docs`` is (doc_id, title, created), ``messages`` (doc_id, session, started, seq, text).  Messages
    are those of the newest sessions of the newest documents, a fixed number of each, and of hits.
    """
    asked = term.strip().lower()
    titles = docs.where(F.contains(F.lower("title"), F.lit(asked))).select(F.lit("title").alias("kind"), "doc_id", "title", F.lit(None).cast("string").alias("snippet"))
    newest = docs.orderBy(F.desc("created"), "doc_id").limit(most_docs).select("doc_id", "title", "created")
    sessions = messages.select("doc_id", "session", "started").distinct().join(newest, "doc_id")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("started"), "session"))
    seen = sessions.withColumn("_s", turn).where(F.col("_s") <= most_sessions)
    at = F.instr(F.lower("text"), asked)
    hits = messages.drop("started").join(seen, ["doc_id", "session"]).withColumn("_at", at).where("_at > 0").orderBy(F.desc("created"), "doc_id", "_s", "seq").limit(limit)
    begin = F.greatest(F.col("_at") - 31, F.lit(0))
    cut = F.regexp_replace(F.substring(F.col("text"), begin + 1, F.lit(110)), r"\s+", " ")
    shown = F.concat(F.when(begin > 0, "…").otherwise(""), cut, F.when(begin + 110 < F.length("text"), "…").otherwise(""))
    return titles.unionByName(hits.select(F.lit("message").alias("kind"), "doc_id", "title", shown.alias("snippet")))
