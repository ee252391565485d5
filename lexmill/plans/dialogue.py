"""Queries on routing and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..operators import chat as C
from ..operators import evaluate as E
from ..operators import logistic as L
from ..operators import routing as R
from .catalog import query, table
from .duck import Inline, in_list, stem, text

def with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with the text of a benchmark item, all items in turn."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(items.agg(F.count("*").alias("_n"))))
    return docs.join(items, F.col("item_id") == F.col("doc_id") % F.col("_n")).drop("_n")


MESSAGES = Inline("msg_id long, query string", list(enumerate((
    "quiz me on chapter two", "give me 10 practice questions", "do some research on tides", "recommend some good books", "I don't understand osmosis",
    "what is osmosis", "hello", "Test my knowledge with multiple choice", "search the web for recent studies", "resources in the document", "study resources please",
    "explain it again", "quiz me and find videos", "where can I learn more", "define entropy", "why?", "  ", "materials on this text and other materials",
    "generate a few important exam questions", "this is not clear", "walk me through it slower", "likely exam questions",
), 1)))
_LOOK = " (in|from|of|on) (the|this) (document|text|file)"


def _rule(intent: str, name: str, rx: str) -> str:
    x = "trim(query)"
    if "(?!" in rx:  # RE2 has no lookahead: drop what it excludes, then look
        rx = rx.partition("(?!")[0]
        x = f"regexp_replace({x}, {text('(?i)' + rx + _LOOK)}, ' ', 'g')"
    return f"CASE WHEN regexp_matches({x}, {text('(?i)' + rx)}) THEN '{intent}:{name}' END"


_STRONG = "list_filter([" + ", ".join(_rule(i, n, rx) for i, rules in R.STRONG.items() for n, rx in rules) + "], lambda x: x IS NOT NULL)"
_WEAK = "list_filter([" + ", ".join(_rule("question", n, rx) for n, rx in R.WEAK) + "], lambda x: x IS NOT NULL)"
_ALL = f"(SELECT msg_id, query FROM {MESSAGES.sql} UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user')"
_FIRST = "CASE " + " ".join(f"WHEN list_contains(intents, '{i}') THEN '{i}'" for i in R.PRIORITY) + " END"


@query(
    "route_rules",
    f"""WITH h AS (SELECT msg_id, query, {_STRONG} AS strong, {_WEAK} AS weak FROM {_ALL}), i AS (SELECT *, list_distinct(list_transform(strong, lambda r: split_part(r, ':', 1))) AS intents FROM h)
SELECT msg_id, coalesce({_FIRST}, 'question') AS intent, round(CASE WHEN len(intents) = 1 THEN least(0.99::DOUBLE, {S.router_rule_confidence}::DOUBLE + 0.02::DOUBLE * (len(strong) - 1)) WHEN len(intents) > 1 OR len(weak) > 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END, 4) AS confidence,
CASE WHEN len(intents) > 0 OR len(weak) > 0 THEN 'rules' ELSE 'fallback' END AS method, array_to_string(CASE WHEN len(strong) > 0 THEN strong ELSE weak END, ',') AS matched_rules FROM i""",
)
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without a classifier."""
    talk = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("msg_id"), F.col("text").alias("query"))
    out = R.route(MESSAGES.spark(spark).unionByName(talk))
    return out.select("msg_id", "intent", "confidence", "method", F.array_join("matched_rules", ",").alias("matched_rules"))


PROBS = Inline("msg_id long, quiz double, question double, resources double, doubt double", [(i, 0.1 + 0.01 * (i % 3), 0.2 + 0.05 * (i % 7), 0.3, 0.05) for i in range(1, 23)])


@query(
    "route_cascade",
    f"""WITH h AS (SELECT msg_id, query, {_STRONG} AS strong, {_WEAK} AS weak, p.* EXCLUDE (msg_id) FROM {MESSAGES.sql} JOIN {PROBS.sql} p USING (msg_id)),
i AS (SELECT *, list_distinct(list_transform(strong, lambda r: split_part(r, ':', 1))) AS intents FROM h),
e AS (SELECT msg_id, any_value(intents) AS intents, any_value(strong) AS strong, any_value(weak) AS weak, max(v) AS top, arg_max(k, v * 1000 - pr) AS top_k, coalesce(sum(v) FILTER (WHERE list_contains(intents, k)), 0) AS total,
  arg_max(k, v * 1000 - pr) FILTER (WHERE list_contains(intents, k)) AS pick, max(v) FILTER (WHERE list_contains(intents, k)) AS pick_v
  FROM i, LATERAL (SELECT unnest(['quiz', 'question', 'resources', 'doubt']) AS k, unnest([quiz, question, resources, doubt]) AS v, unnest([1, 6, 4, 5]) AS pr) GROUP BY msg_id)
SELECT msg_id, CASE WHEN len(intents) = 1 THEN intents[1] WHEN len(intents) > 1 THEN pick WHEN top >= {S.router_min_probability} THEN top_k ELSE 'question' END AS intent,
round(CASE WHEN len(intents) = 1 THEN least(0.99::DOUBLE, {S.router_rule_confidence}::DOUBLE + 0.02::DOUBLE * (len(strong) - 1)) WHEN len(intents) > 1 THEN pick_v / CASE WHEN total = 0 THEN 1 ELSE total END WHEN top >= {S.router_min_probability} THEN top WHEN len(weak) > 0 THEN 0.5::DOUBLE ELSE top END, 4) AS confidence,
CASE WHEN len(intents) = 1 THEN 'rules' WHEN len(intents) > 1 THEN 'classifier' WHEN top >= {S.router_min_probability} THEN 'classifier' WHEN len(weak) > 0 THEN 'rules' ELSE 'fallback' END AS method FROM e""",
)
def route_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with given classifier probabilities."""
    names = [f[0] for f in PROBS.fields[1:]]
    probs = PROBS.spark(spark).select("msg_id", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("probs"))
    return R.route(MESSAGES.spark(spark).join(probs, "msg_id"), probs="probs").select("msg_id", "intent", "confidence", "method")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "query", F.col("quality").cast("string").alias("intent"))


@query("route_classifier")
def route_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the two quality labels, as a stand-in for intents."""
    return L.probabilities(_labelled(spark, sf_dir), "intent", "query").select("doc_id", F.round(F.col("probs")["1"], 6).alias("p_good"))


@query("stratified_cv")
def stratified_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cross_validate(R.stratified_folds(_labelled(spark, sf_dir), "intent", "doc_id"), "intent", "query")


@query("label_integrity", "SELECT lang AS intent, count(*) AS n, count(*) - count(DISTINCT lower(trim(text))) AS duplicates, count(*) = 40 AS complete FROM documents GROUP BY lang")
def label_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_integrity(table(spark, sf_dir, "documents").select(F.col("text").alias("query"), F.col("lang").alias("intent")))


FOLLOW = Inline("conv_id long, turn long, role string, text string", [
    (-1, 0, "system", "be kind"), (-1, 1, "user", "What is osmosis?"), (-1, 2, "assistant", "Osmosis is water moving. [1]"), (-1, 3, "user", "why?"), (-1, 4, "user", "I still don't get it"),
    (-1, 5, "assistant", "y" * 1600), (-1, 6, "user", "what about its limitations"), (-1, 7, "user", "Explain the light dependent reactions of plants in full detail today"),
    (-1, 8, "user", "And diffusion?"), (-1, 9, "user", "  "), (-2, 1, "user", "explain that again"), (-2, 2, "user", "What is ATP?"), (-2, 3, "user", "x" * 1501),
])
_TALK = f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM {FOLLOW.sql})"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(FOLLOW.spark(spark))


def _count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> ''))"


def _content(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9'']+'), lambda w: w <> '' AND NOT {in_list('w', C.TOPICLESS)}))"


def _follow(x: str) -> str:
    return f"({_count(x)} > 0 AND ({_content(x)} = 0 OR ({_count(x)} <= 8 AND (regexp_matches({x}, {text(C.ANAPHORA)}) OR regexp_matches({x}, {text(C.CONNECTIVE)})))))"


@query("followup_flags", f"SELECT conv_id, turn, {_count('text')} AS n_words, {_content('text')} AS n_content, {_follow('text')} AS follow_up FROM {_TALK} WHERE role = 'user'")
def followup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return _talk(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", C.word_count(x).cast("long").alias("n_words"), C.content_word_count(x).cast("long").alias("n_content"), C.is_follow_up(x).alias("follow_up"))


@query(
    "rewritten_query",
    f"""WITH w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {_TALK})
SELECT conv_id, turn, CASE WHEN {_follow('trim(text)')} AND last IS NOT NULL THEN last || ' ' || trim(text) ELSE trim(text) END AS retrieval_query FROM w WHERE role = 'user'""",
)
def rewritten_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rewritten(_talk(spark, sf_dir), "conv_id", "turn", "role", "text").select("conv_id", "turn", "retrieval_query")


@query(
    "chat_history_window",
    f"""WITH s AS (SELECT *, CASE WHEN role = 'user' THEN 'Student' ELSE 'Assistant' END || ': ' || CASE WHEN length(text) > {S.history_chars} THEN left(text, {S.history_chars}) || '...' ELSE text END AS line FROM {_TALK} WHERE role IN ('user', 'assistant')),
h AS (SELECT *, list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {S.history_messages} PRECEDING AND 1 PRECEDING) AS h FROM s)
SELECT conv_id, turn, CASE WHEN len(h) > 0 THEN array_to_string(h, chr(10)) ELSE '(no previous messages)' END AS history FROM h WHERE role = 'user'""",
)
def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(_talk(spark, sf_dir), "conv_id", "turn", "role", "text").select("conv_id", "turn", "history")


@query("session_listing", f"SELECT conv_id, count(*) AS message_count, max(turn) AS last_seq FROM {_TALK} GROUP BY conv_id")
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.session_listing(_talk(spark, sf_dir), "conv_id", "turn")


@query(
    "chat_search",
    """WITH f AS (SELECT conv_id, turn, text, strpos(lower(text), 'and') AS found FROM conversations WHERE strpos(lower(text), 'and') > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM f QUALIFY r <= 5)
SELECT conv_id, turn, substr(text, greatest(found - 30, 1), 110) AS snippet FROM r ORDER BY conv_id, turn LIMIT 20""",
)
def chat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "and")


ANSWERS = Inline("answer_id long, answer string", [(1, "A [1]. B [2][5]. C [3, 4]. D [x] [12]"), (2, "none"), (3, "[[INSUFFICIENT_CONTEXT]] The excerpts do not mention it."), (4, "[2, 2] and [ 7]"), (5, "It isn't covered; I cannot find it.")])
PASSAGES = Inline("answer_id long, chunk_id string, position long, heading string, text string", [(a, f"c{p}", p, "Head" if p % 2 else "", f"passage {p} " + "word " * (p * 30)) for a in (1, 2, 4) for p in range(4)])
_CITES = f"list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, {text(C.CITATION)}, 1), lambda x: string_split(x, ','))), lambda n: trim(n)::BIGINT))"


@query("citations_extract", f"SELECT answer_id, array_to_string(list_sort({_CITES}), ',') AS cited FROM {ANSWERS.sql}")
def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANSWERS.spark(spark).select("answer_id", F.array_join(F.array_sort(C.citations(F.col("answer"))), ",").alias("cited"))


@query(
    "sources_cited",
    f"""SELECT answer_id, position + 1 AS label, chunk_id, CASE WHEN length(text) > {S.snippet_chars} THEN rtrim(left(text, {S.snippet_chars})) || '...' ELSE text END AS snippet, list_contains({_CITES}, position + 1) AS cited
FROM {PASSAGES.sql} JOIN {ANSWERS.sql} USING (answer_id)""",
)
def sources_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cited_sources(PASSAGES.spark(spark), ANSWERS.spark(spark))


@query("insufficient_flags", f"SELECT answer_id, contains(answer, {text(C.INSUFFICIENT)}) AS insufficient, trim(replace(answer, {text(C.INSUFFICIENT)}, '')) AS answer FROM {ANSWERS.sql}")
def insufficient_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, rest = C.insufficient(F.col("answer"))
    return ANSWERS.spark(spark).select("answer_id", flag.alias("insufficient"), rest.alias("answer"))


@query(
    "context_blocks",
    f"""SELECT answer_id, string_agg('[' || (position + 1) || ']' || CASE WHEN heading <> '' THEN ' (Section: ' || heading || ')' ELSE '' END || chr(10) || trim(text), chr(10) || chr(10) ORDER BY position) AS context FROM {PASSAGES.sql} GROUP BY answer_id""",
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.context_blocks(PASSAGES.spark(spark), "answer_id", "position")


@query("abstain_flags", f"SELECT answer_id AS id, regexp_matches(answer, {text(E.ABSTAIN)}) AS abstained FROM {ANSWERS.sql} UNION ALL SELECT conv_id * 1000 + turn + 1000, regexp_matches(text, {text(E.ABSTAIN)}) FROM conversations")
def abstain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("answer_id"), F.col("text").alias("answer"))
    return ANSWERS.spark(spark).unionByName(talk).select(F.col("answer_id").alias("id"), E.abstained(F.col("answer")).alias("abstained"))


FACTS = Inline("id long, answer string, facts array<string>", [(1, "Plants use light energies to make sugars.", ["light energy", "sugar", "water"]), (2, "", ["x"]), (3, "ATP is made.", []), (4, "The value is 3.14 now", ["3.14", "values"])])
_FS = "list_distinct(list_transform(regexp_extract_all(lower({}), '[a-z0-9+.]+'), lambda w: " + stem("w") + "))"


@query(
    "fact_recall",
    f"""WITH x AS (SELECT id, answer, {_FS.format('answer')} AS have, facts FROM {FACTS.sql} UNION ALL SELECT 1000 + d.doc_id, d.text, {_FS.format('d.text')}, [left(b.text, 20), b.text] FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT id, CASE WHEN len(facts) = 0 THEN 0::DOUBLE ELSE round(len(list_filter(facts, lambda f: contains(lower(answer), lower(f)) OR (len({_FS.format('f')}) > 0 AND len(list_filter({_FS.format('f')}, lambda s: NOT list_contains(have, s))) = 0))) / len(facts)::DOUBLE, 6) END AS recall FROM x""",
)
def fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_items(spark, sf_dir).select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("answer"), F.array(F.substring("item", 1, 20), F.col("item")).alias("facts"))
    return FACTS.spark(spark).unionByName(pairs).select("id", F.round(E.fact_recall(F.col("answer"), F.col("facts")), 6).alias("recall"))


def _rouge(n: int) -> str:
    def grams(col: str, name: str) -> str:
        return f"{name}w AS (SELECT id, regexp_extract_all(lower({col}), '[a-z0-9]+') AS w FROM p), {name} AS (SELECT id, any_value(total) AS total, gram, count(*) AS c FROM (SELECT id, len(w) - {n - 1} AS total, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS gram FROM {name}w WHERE len(w) >= {n}) GROUP BY id, gram)"

    return f"""WITH p AS (SELECT d.doc_id AS id, d.text AS c, b.text AS r FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), {grams('c', 'cg')}, {grams('r', 'rg')},
o AS (SELECT id, sum(least(cg.c, rg.c))::DOUBLE AS o FROM cg JOIN rg USING (id, gram) GROUP BY id), t AS (SELECT p.id, coalesce(o, 0) AS o, coalesce((SELECT any_value(total) FROM cg WHERE cg.id = p.id), 0) AS nc, coalesce((SELECT any_value(total) FROM rg WHERE rg.id = p.id), 0) AS nr FROM p LEFT JOIN o USING (id)),
f AS (SELECT id, CASE WHEN nc > 0 THEN o / nc ELSE 0 END AS pr, CASE WHEN nr > 0 THEN o / nr ELSE 0 END AS re FROM t)
SELECT id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM f"""


def _rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_items(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("c"), F.col("item").alias("r"))


@query("rouge_1", _rouge(1))
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_n(_rouge_pairs(spark, sf_dir), "id", "c", "r", 1).select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("rouge_2", _rouge(2))
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_n(_rouge_pairs(spark, sf_dir), "id", "c", "r", 2).select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("rouge_l")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_l(_rouge_pairs(spark, sf_dir), "id", "c", "r").withColumn("f1", F.round("f1", 6))
