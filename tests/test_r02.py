"""Faults that the second round's review found, each on rows that showed it."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from lexmill.plans import ORACLES, QUERIES

TABLES = ("conversations", "documents", "events", "labels", "benchmark")


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL twin over small tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    out = QUERIES[name](spark, str(folder))
    cols = sorted(out.columns)
    ours = sorted(map(tuple, out.select(*cols).collect()), key=str)
    return ours, sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall(), key=str)


def test_topics_beside_letters_beyond_ascii(spark, tmp_path):
    said = ["An\u00ea de leouaux", "\u00e9study \u00e9tude", "re\u017fearch plants", "loo\u212a into plants", "the\u00e9 light", "plants\u00a0", "\u3000plants ", "a\x0bplants", "\u0130x", "studyx study\u00e9", None]
    ours, theirs = both(spark, tmp_path, "topic_extraction", conversations=spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string"))
    assert ours == theirs


def test_video_lengths_round_halves_to_even(spark, tmp_path):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate((84.25, 84.35, 84.05, 84.15, 240.05, 29.95, 84.0005))], "event_id long, value double")
    events = rows.withColumn("ts", F.lit("2024-12-01 00:00:00").cast("timestamp_ntz")).withColumn("event_type", F.lit("view"))
    ours, theirs = both(spark, tmp_path, "video_rank", events=events)
    assert ours == theirs
    # The length of 240.05, 2400 seconds, still fits.
    few = rows.where("value > 200").join(events.select("event_id", "ts", "event_type"), "event_id")
    ours, theirs = both(spark, tmp_path, "video_rank", events=few)
    assert ours == theirs and any(r[3] == "ev4" for r in ours)


def test_simhash_broadcasts_nothing(spark, sf):
    """However small its tables are on the wire, the driver holds none of them."""
    from lexmill.llm import simhash

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50)
    fps = simhash.fingerprints(rows).select("fp").distinct()
    for out in (simhash.near_duplicates(rows), simhash.links(fps)):
        out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_terms_in_python_are_those_of_the_columns(spark):
    from collections import Counter

    from lexmill.functions.lexical import tokens
    from lexmill.operators.retrieval import counted_terms

    texts = ["The plants' PROCESSES weren't ties, bus IS analysis 7 x 2020 o'clock's loudly ingly", "İstanbul looKed reſearched études cafés", "a'b can't 5's boxes classes passes yes ies dies", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t"))).collect()
    assert [Counter(r[0] or []) for r in got] == [counted_terms(t, {}) for t in texts]


def test_pairs_are_not_shuffled(spark):
    """Every document shares a term with every question, yet few rows leave a task."""
    from lexmill.operators import retrieval

    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("light plants "), F.repeat(F.lit("water "), (F.col("id") % 7).cast("int")), F.when(F.col("id") == 2999, "roots").otherwise("")).alias("text"))
    queries = spark.createDataFrame([(1, "light plants"), (2, "plants light roots"), (3, "light plants roots")], "query_id long, text string")
    scorer = retrieval.Scorer(docs, queries)
    assert scorer.pairs().count() == 9000
    assert scorer.best(0.4, 8).count() <= 3 * 24 * 80  # ties stay
    plan = scorer.pairs()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fingerprints_tie_near_copies(spark):
    """The stage looks SimHash fingerprints up by multi-index hashing; whole sets decide on what that links."""
    from lexmill.llm import simhash

    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words[::-1]), " ".join(words[i ^ 1] for i in range(4000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = simhash.shingle_sets(rows, "doc_id", "text", 5).withColumnRenamed("doc_id", "node")
    assert {r.node: r.fp & (1 << 64) - 1 for r in sets.collect()} == {i: simhash.simhash(t, 5) for i, t in enumerate(texts)}
    assert [tuple(r) for r in simhash.fingerprint_edges(sets, 0.8).collect()] == [(1, 0)]
    # Fingerprints that are close by chance tie nothing.
    same = sets.withColumn("fp", F.lit(7).cast("long"))
    assert [tuple(r) for r in simhash.fingerprint_edges(same, 0.8).collect()] == [(1, 0)]
    assert sorted(r.doc_id for r in simhash.keep_representatives(rows).collect()) == [0, 2, 3]


def test_pipeline_hands_python_small_batches(spark, sf):
    import corpus_pipeline

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.createDataFrame([(1, "a plain text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, rows, sf).collect()] == [1]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_duplicates_leave_no_shuffle_and_keep_sets_once(spark, tmp_path):
    """Shuffle files go with their query; the wide sets are written once, dealt by node."""
    import os

    import corpus_pipeline
    from lexmill.llm import runtime

    words = [f"w{i}" for i in range(3000)]
    rows = spark.createDataFrame([(i, " ".join(words[i % 7 :]), "en") for i in range(40)], "doc_id long, text string, lang string").repartition(3)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: local.getAllFiles().mkString("\n").count("/shuffle_")
    before = left()
    del runtime._WRITTEN[:]
    corpus_pipeline.near_duplicates(spark, rows, "").write.parquet(str(tmp_path / "kept"))
    assert left() <= before
    wide = [p for p in runtime._WRITTEN if os.path.isdir(p) and "grams" in spark.read.parquet(p).columns]
    assert len(wide) == 1
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [0]
    runtime.drop_staged(spark)


def test_classifier_by_rows_takes_the_steps_of_mllib(spark):
    """Nothing of the size of the vocabulary is in the driver, yet the probabilities are those of MLlib."""
    from lexmill.operators import logistic, routing

    said = [(i, " ".join(f"w{(i * k * 7 + k) % 23}" for k in range(1, 9)) + (" Quiz me" if i % 3 == 0 else " plain it's" if i % 5 else ""), "ab"[i % 3 == 0 or i % 7 == 0]) for i in range(40)]
    rows = spark.createDataFrame(said, "id long, query string, intent string").repartition(3)
    model = routing.classifier().fit(routing.balanced(rows))
    theirs = {r.id: r.probs for r in routing.probabilities(model, rows.select("id", "query")).collect()}
    ours = {r.id: r.probs for r in logistic.probabilities(rows, "intent", "query").collect()}
    assert ours.keys() == theirs.keys() and all(abs(ours[i][c] - theirs[i][c]) < 1e-6 for i in ours for c in "ab")
    # Null texts and rows without a label count as rows, the latter teach nothing.
    odd = rows.unionByName(spark.createDataFrame([(98, None, "a"), (99, "w1 w2", None)], rows.schema))
    assert set(ours) | {98, 99} == {r.id for r in logistic.probabilities(odd, "intent", "query").collect()}
    out = routing.cross_validate(odd.withColumn("fold", F.col("id") % 2), "intent", "query", 2).collect()
    assert [r.n for r in out] == [21, 21]
