"""Queries on retrieval and its evaluation: documents as passages, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS as S
from ..functions.lexical import stem, tokens
from ..operators import evaluate as E
from ..operators import retrieval as R
from . import duck
from .catalog import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Scores of all pairs that share a term, as the Spark plan has them, in SQL.
PAIRS = f"""
WITH toks AS (SELECT doc_id, {duck.tokens('text')} AS t FROM documents),
post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM toks),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
terms AS (SELECT term, n, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf, ln((2 + n) / (1 + df)) + 1 AS idf0, ln((2 + n) / (2 + df)) + 1 AS idf1 FROM df, size),
mean AS (SELECT avg(idf) AS mean_idf FROM terms),
norms AS (SELECT doc_id, sum(((1 + ln(tf)) * idf0) ** 2) AS norm0 FROM post JOIN terms USING (term) GROUP BY doc_id),
qt AS (SELECT item_id AS query_id, {duck.tokens('text')} AS t FROM benchmark),
q AS (SELECT query_id, term, count(*)::DOUBLE AS qtf, any_value(n_terms)::DOUBLE AS n_terms FROM (SELECT query_id, len(list_distinct(t)) AS n_terms, unnest(t) AS term FROM qt) GROUP BY query_id, term),
q_norm AS (SELECT query_id, sqrt(sum(((1 + ln(qtf)) * coalesce(idf1, ln((2 + size.n) / 2) + 1)) ** 2)) AS q_norm FROM q LEFT JOIN terms USING (term), size GROUP BY query_id),
raw AS (SELECT query_id, doc_id,
    greatest(sum(qtf * CASE WHEN idf < 0 THEN {S.bm25_epsilon}::DOUBLE * mean_idf ELSE idf END * (tf * {S.bm25_k1 + 1}::DOUBLE) / (tf + {S.bm25_k1}::DOUBLE * (1 - {S.bm25_b}::DOUBLE + {S.bm25_b}::DOUBLE * dl / avgdl))), 0::DOUBLE) AS bm25,
    sum((1 + ln(qtf)) * idf1 * (1 + ln(tf)) * idf1) AS dot, sum(((1 + ln(tf)) * idf1) ** 2 - ((1 + ln(tf)) * idf0) ** 2) AS shift,
    count(*)::DOUBLE / any_value(n_terms) AS coverage, any_value(n) AS n
  FROM q JOIN terms USING (term) JOIN post USING (term), mean GROUP BY query_id, doc_id),
span AS (SELECT *, CASE WHEN count(*) OVER w < n THEN 0::DOUBLE ELSE min(bm25) OVER w END AS lo, max(bm25) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY query_id)),
pairs AS (SELECT query_id, doc_id, bm25, coverage,
    CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE (bm25 - lo) / (hi - lo) END AS bm25_norm,
    greatest(0::DOUBLE, least(1::DOUBLE, dot / (sqrt(norm0 + shift) * q_norm))) AS cosine
  FROM span JOIN norms USING (doc_id) JOIN q_norm USING (query_id))"""

RELEVANT = f""",
rel AS (SELECT *, round({S.alpha}::DOUBLE * bm25_norm + (1 - {S.alpha}::DOUBLE) * cosine, 9) AS relevance FROM pairs),
cand AS (SELECT * FROM rel WHERE relevance > 0 QUALIFY relevance >= {S.min_relevance_ratio}::DOUBLE * max(relevance) OVER (PARTITION BY query_id))"""

KNOWLEDGE = f"""{PAIRS}{RELEVANT},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM cand QUALIFY rank <= {S.top_k_knowledge})"""


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_knowledge(_docs(spark, sf_dir), _questions(spark, sf_dir))


@query("retrieve_knowledge", f"{KNOWLEDGE} SELECT query_id, rank, doc_id, round(bm25, 4) AS bm25_score, round(bm25_norm, 4) AS bm25_norm, round(cosine, 4) AS cosine, round(relevance, 4) AS relevance FROM top")
def retrieve_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _knowledge(spark, sf_dir)
    return out.select("query_id", "rank", "doc_id", F.round("bm25", 4).alias("bm25_score"), *[F.round(c, 4).alias(c) for c in ("bm25_norm", "cosine", "relevance")])


@query("retrieve_tfidf_cosine", f"{PAIRS} SELECT query_id, doc_id, round(cosine, 6) AS cosine FROM pairs WHERE round(cosine, 9) > 0")
def retrieve_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with a positive TF-IDF cosine, statistics fitted per query."""
    pairs = R.scores(_docs(spark, sf_dir), _questions(spark, sf_dir))
    return pairs.where(F.round("cosine", 9) > 0).select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"))


#: Importance of a document: its quality label, halved if toxic; most have none.
_IMPORTANCE = "SELECT doc_id, max(CASE WHEN toxic = 1 THEN 0.5::DOUBLE * quality ELSE quality::DOUBLE END) AS importance FROM labels GROUP BY doc_id"


@query(
    "retrieve_exam",
    f"""{PAIRS}{RELEVANT},
pool AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) <= {S.top_k_exam * S.exam_candidate_multiplier}),
imp AS (SELECT doc_id, coalesce(importance, 0::DOUBLE) AS importance FROM documents LEFT JOIN ({_IMPORTANCE}) USING (doc_id)),
norm AS (SELECT doc_id, CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE (importance - lo) / (hi - lo) END AS importance_norm FROM imp, (SELECT min(importance) AS lo, max(importance) AS hi FROM imp)),
fin AS (SELECT *, round({S.exam_relevance_weight}::DOUBLE * relevance + {S.exam_importance_weight}::DOUBLE * importance_norm, 9) AS final_score FROM pool JOIN norm USING (doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, relevance DESC, doc_id) AS rank FROM fin QUALIFY rank <= {S.top_k_exam})
SELECT query_id, rank, doc_id, round(relevance, 4) AS relevance, round(importance_norm, 4) AS importance_norm, round(final_score, 4) AS final_score FROM top""",
)
def retrieve_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = F.when(F.col("toxic") == 1, 0.5 * F.col("quality")).otherwise(F.col("quality").cast("double"))
    importance = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(worth).alias("importance"))
    out = R.retrieve_exam(_docs(spark, sf_dir), _questions(spark, sf_dir), importance)
    return out.select("query_id", "rank", "doc_id", *[F.round(c, 4).alias(c) for c in ("relevance", "importance_norm", "final_score")])


@query(
    "retrieve_sufficiency",
    f"""{KNOWLEDGE}, best AS (SELECT query_id, count(*) AS n_selected, max(cosine) AS max_cosine, max(coverage) AS coverage FROM top GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n_selected, 0) AS n_selected, round(coalesce(max_cosine, 0), 4) AS max_cosine, round(coalesce(coverage, 0), 4) AS coverage,
  coalesce(n_selected, 0) > 0 AND coalesce(coverage, 0) >= {S.sufficient_coverage} AS sufficient FROM benchmark LEFT JOIN best ON item_id = query_id""",
)
def retrieve_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.sufficiency(_knowledge(spark, sf_dir), _questions(spark, sf_dir))
    return out.select("query_id", "n_selected", F.round("max_cosine", 4).alias("max_cosine"), F.round("coverage", 4).alias("coverage"), "sufficient")


_N = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_EVAL = f"""{PAIRS},
gold AS (SELECT query_id, doc_id FROM pairs JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE coverage >= 1 AND contains({_N.format('d.text')}, {_N.format('b.text')})),
rel AS (SELECT alpha, p.*, round(alpha * bm25_norm + (1 - alpha) * cosine, 9) AS relevance FROM pairs p, (SELECT unnest([0, 0.2, 0.4, 0.6, 0.8, 1])::DOUBLE AS alpha)),
cand AS (SELECT * FROM rel WHERE relevance > 0 QUALIFY relevance >= {S.min_relevance_ratio}::DOUBLE * max(relevance) OVER (PARTITION BY alpha, query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY relevance DESC, doc_id) AS rank FROM cand),
hit AS (SELECT alpha, query_id, min(rank) AS first_rank FROM rk SEMI JOIN gold USING (query_id, doc_id) GROUP BY alpha, query_id),
asked AS (SELECT DISTINCT alpha, query_id FROM (SELECT unnest([0, 0.2, 0.4, 0.6, 0.8, 1])::DOUBLE AS alpha), gold)"""
_METRICS = ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1::DOUBLE ELSE 0::DOUBLE END), 4) AS recall_at_{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1::DOUBLE / first_rank, 0)), 4) AS mrr, count(*) AS n_questions"


@query("alpha_sweep_eval", f"{_EVAL} SELECT alpha, {_METRICS} FROM asked LEFT JOIN hit USING (alpha, query_id) GROUP BY alpha")
def alpha_sweep_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.alpha_sweep(_docs(spark, sf_dir), _questions(spark, sf_dir), (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))


@query("recall_mrr", f"{_EVAL} SELECT query_id, first_rank, round(coalesce(1::DOUBLE / first_rank, 0), 6) AS reciprocal_rank FROM asked LEFT JOIN hit USING (alpha, query_id) WHERE alpha = 0.4")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first relevant document of each question that has one."""
    out = E.first_ranks(_docs(spark, sf_dir), _questions(spark, sf_dir), (S.alpha,))
    return out.select("query_id", "first_rank", F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


@query("lexical_tokens", f"SELECT item_id, array_to_string({duck.tokens('text')}, ' ') AS tokens, array_to_string({duck.content_stems('text')}, ' ') AS stems FROM benchmark")
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.lexical import content_stems

    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"), F.array_join(content_stems(F.col("text")), " ").alias("stems"))


_STEMS = duck.Inline("word string", [(w,) for w in "plants processes energies converting photosynthesis ties bus analysis glass running loudly lovingly markedly boxes is 1990s 2020 used ads ingly".split()])


@query("lexical_stem", f"SELECT word, {duck.stem('word')} AS stem FROM {_STEMS.sql}")
def lexical_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _STEMS.spark(spark).select("word", stem(F.col("word")).alias("stem"))


#: Documents with a vector of their own number; the first items ask with one, others with what a gate stops.
_VECS = """vd AS (SELECT doc_id, text, embedding::DOUBLE[] AS vector FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 THEN NULL WHEN item_id % 4 = 2 THEN (e.embedding::DOUBLE[])[1:8] ELSE e.embedding::DOUBLE[] END AS vector, CASE WHEN item_id % 8 = 1 THEN 'other' ELSE 'm' END AS model FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
gates AS (SELECT query_id, CASE WHEN vector IS NULL THEN 'no_query_model' WHEN len(vector) <> 64 OR model <> 'm' THEN 'other_model' ELSE 'dense' END AS gate FROM asked)"""


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = _docs(spark, sf_dir).join(vecs.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    vectors = vecs.join(docs, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.lit("m").alias("model"))
    items = _questions(spark, sf_dir).join(vecs, F.col("vec_id") == F.col("query_id"))
    kind = F.col("query_id") % 4
    vector = F.when(kind == 3, None).when(kind == 2, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    asked = items.select("query_id", vector.alias("vector"), F.when(F.col("query_id") % 8 == 1, "other").otherwise("m").alias("model"))
    return docs, items.select("query_id", "text"), vectors, asked


@query(
    "retrieve_hybrid_dense",
    f"""{PAIRS.replace('FROM documents)', 'FROM vd)', 1).replace('WITH toks', f'WITH {_VECS}, toks', 1).replace('FROM benchmark)', 'FROM benchmark SEMI JOIN asked ON query_id = item_id)', 1)},
cosd AS (SELECT query_id, doc_id, round(greatest(0, least(1, list_cosine_similarity(v.vector, a.vector))), 9) AS dense FROM vd v, asked a JOIN gates g USING (query_id) WHERE gate = 'dense'),
mixed AS (SELECT query_id, doc_id, coalesce(bm25_norm, 0) AS bm25_norm, dense AS cosine, 'dense' AS gate FROM cosd LEFT JOIN pairs USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, bm25_norm, cosine, gate FROM pairs JOIN gates USING (query_id) WHERE gate <> 'dense'),
rel AS (SELECT *, round({S.alpha}::DOUBLE * bm25_norm + (1 - {S.alpha}::DOUBLE) * cosine, 9) AS relevance FROM mixed),
cand AS (SELECT * FROM rel WHERE relevance > 0 QUALIFY relevance >= {S.min_relevance_ratio}::DOUBLE * max(relevance) OVER (PARTITION BY query_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM cand QUALIFY rank <= {S.top_k_knowledge})
SELECT query_id, rank, doc_id, gate, round(bm25_norm, 4) AS bm25_norm, round(cosine, 4) AS cosine, round(relevance, 4) AS relevance FROM top""",
)
def retrieve_hybrid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with vectors where the gate lets a query through, else with TF-IDF."""
    out = R.retrieve_hybrid(*_with_vectors(spark, sf_dir))
    return out.select("query_id", "rank", "doc_id", "gate", *[F.round(c, 4).alias(c) for c in ("bm25_norm", "cosine", "relevance")])


_GATED = duck.Inline("query_id long, gate string", [(1, "dense"), (2, "no_query_model"), (3, "other_model"), (4, "other_model")])


@query("dense_gates", f"SELECT query_id, gate, 'all' AS stored FROM {_GATED.sql} UNION ALL SELECT query_id, 'no_vectors', 'some' FROM {_GATED.sql} UNION ALL SELECT query_id, 'fallback_vectors', 'fallback' FROM {_GATED.sql}")
def dense_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries the stored vectors can answer: all there, one missing, fallback vectors."""
    docs, asked = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, None, None), (3, [1.0], "m"), (4, [0.0, 1.0], "x")], "query_id long, vector array<double>, model string")
    vecs = spark.createDataFrame([(1, [1.0, 1.0], "m"), (2, [0.0, 0.0], "m")], "doc_id long, vector array<double>, model string")
    cases = {"all": vecs, "some": vecs.where("doc_id = 1"), "fallback": vecs.withColumn("model", F.lit(R.FALLBACK))}
    rows = [R.dense_gate(docs, v, asked).withColumn("stored", F.lit(name)) for name, v in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "vector_topk_cosine",
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0, least(1, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS cosine
  FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p QUALIFY rank <= 8)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank FROM r""",
)
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest vectors of every stated query vector, over all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return R.vector_top_k(asked, vectors, 8).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")
