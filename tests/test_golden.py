"""Literal expectations of single operators; each changes at least one row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmill.functions.lexical import cosine, stem, tokens
from lexmill.operators import assess as A
from lexmill.operators import chat, cleaning, evaluate, graph, keywords, research, retrieval, routing, structure
from lexmill.sources import connectors, files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("word, out", [("plants", "plant"), ("processes", "process"), ("energies", "energy"), ("converting", "convert"), ("photosynthesis", "photosynthesis")])
def test_stem(spark, word, out):
    assert one(spark, word, stem) == out


def test_tokens(spark):
    assert one(spark, "What is the role of the Plants?", tokens) == ["role", "plant"]


@pytest.mark.parametrize("values, out", [([0.0, 0.0], [0, 0]), ([2.0, 2.0], [1, 1]), ([1.0, 3.0, 2.0], [0, 1, 0.5])])
def test_min_max(spark, values, out):
    docs = spark.createDataFrame([(i, "x") for i in range(len(values))], "doc_id long, text string")
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, importance double")
    assert [r[1] for r in retrieval.normalised_importance(docs, rows).orderBy("doc_id").collect()] == out


def test_cosine(spark):
    assert spark.range(1).select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 0.0


@pytest.mark.parametrize("f, text, out", [
    (cleaning.dehyphenate, "auto-\nmatic gener-\nation of text", "automatic generation of text"),
    (cleaning.dehyphenate, "a-\nb-\nc", "abc"),
    (cleaning.blank_page_numbers, "Some heading\n12\nBody text\nPage 3 of 10", "Some heading\n\nBody text\n"),
    (cleaning.join_soft_wraps, "This is a sentence\nthat spans\nthree lines.\nINTRODUCTION\nBody", "This is a sentence that spans three lines.\nINTRODUCTION\nBody"),
    (cleaning.tidy_space, " a \t b \n\n\n\n c ", "a b\n\nc"),
    (cleaning.plain_marks, "‘a’ – “b”", "'a' - \"b\""),
    (cleaning.nfkc, "ﬁne", "fine"),
])
def test_cleaning(spark, f, text, out):
    assert one(spark, text, f) == out


@pytest.mark.parametrize("line, level", [("1. Overview", 1), ("1.1 Background", 2), ("1.1.2 Details", 3), ("- a bullet", 0), ("INTRODUCTION TO CELLS", 1), ("Summary of it", 1), ("Cell Division", 2), ("A plain sentence.", 0), ("2020 was a good year", 1)])
def test_heading_level(spark, line, level):
    assert one(spark, line, structure.heading_level) == level


@pytest.mark.parametrize("text, n", [("Dr. Smith met Prof. Jones at 5 p.m. sharp. They talked.", 2), ("The value is 3.14 today. It rose.", 2), ("It ended in 1990. The war was over.", 1), ("Really? Yes!", 2)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, structure.sentences)) == n


def test_chunks_keep_budget_and_overlap(spark):
    text = "\n".join(" ".join(f"Sentence {k} of line {i} has some words in it." for k in range(4)) for i in range(30))
    rows = structure.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), target=60, overlap=15).orderBy("position").collect()
    assert all(r.token_count <= 60 for r in rows) and len(rows) > 5
    assert all(a.text.rsplit("Sentence", 1)[1] in b.text for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("message, out", [("why?", True), ("what about limitations", True), ("I still don't get it", True), ("Explain that again", True), ("and then?", True), ("What is ATP?", False), ("Explain the light dependent reactions of photosynthesis in detail please now", False), ("", False)])
def test_follow_up(spark, message, out):
    assert one(spark, message, chat.is_follow_up) is out


def test_citations(spark):
    assert one(spark, "A [1]. B [2][5]. C [3, 4]. D [x] [12]", chat.citations) == [1, 2, 5, 3, 4, 12]


def test_render_expands_once():
    assert chat.render("{{a}} and {{ b }}", {"a": "{{b}}", "b": 2}) == "{{b}} and 2" and chat.render("<{{a}}>", {"a": None}) == "<>"
    with pytest.raises(KeyError):
        chat.render("{{a}}", {})


@pytest.mark.parametrize("asked, have, n", [(1, 20, 3), (10, 20, 6), (20, 20, 8), (20, 4, 4)])
def test_pool_size(spark, asked, have, n):
    assert spark.range(1).select(A.pool_size(F.lit(asked), F.lit(have))).first()[0] == n


@pytest.fixture(scope="module")
def pools(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i) for i in range(10)], "doc_id string, chunk_id string, position long")
    worth = spark.createDataFrame([("d", f"c{i}", v) for i, v in ((1, 0.9), (5, 0.8), (8, 0.7), (7, 0.6), (3, 0.5))], "doc_id string, chunk_id string, importance double")
    topics = spark.createDataFrame([("d", 0, "t0", "x", 4, ["c0", "c1", "c2", "c3"]), ("d", 1, "t1", "y", 3, ["c4", "c5", "c6"]), ("d", 2, "t2", "z", 3, ["c7", "c8", "c9"])], "doc_id string, ord long, topic_id string, label string, size long, chunk_ids array<string>")
    return chunks, worth, topics


def ids(df):
    return [r.chunk_id for r in df.orderBy("position").collect()]


def test_pools(spark, pools):
    chunks, worth, topics = pools
    none = worth.where("false")
    assert ids(A.exam_pool(chunks, worth, 5)) == ["c1", "c5", "c7", "c8"]
    assert ids(A.knowledge_pool(chunks, worth, topics, 5)) == ["c1", "c3", "c5", "c8"]
    assert ids(A.exam_pool(chunks, none, 5)) == ["c0", "c2", "c5", "c7"]
    assert ids(A.knowledge_pool(chunks, none, topics.where("false"), 5)) == ["c0", "c2", "c5", "c7"]


@pytest.mark.parametrize("answer, out", [("C", "blue"), ("Option D", "dark red"), ("b) green", "green"), ("  BLUE ", "blue"), ("purple", None)])
def test_resolve_choice(spark, answer, out):
    assert one(spark, answer, lambda a: A.resolve_choice(a, F.array(*map(F.lit, ("red", "green", "blue", "dark red"))))) == out


@pytest.mark.parametrize("message, count, difficulty, kind", [("quiz me with 8 hard multiple choice questions", 8, "hard", "mcq"), ("ten easy essay questions", 10, "easy", "short"), ("test me", 5, "medium", "mixed"), ("500 questions", 20, "medium", "mixed")])
def test_parse_request(spark, message, count, difficulty, kind):
    p = A.parse_request(F.col("x"))
    assert tuple(spark.createDataFrame([(message,)], "x string").select(*p.values()).first()) == (count, difficulty, kind)


@pytest.mark.parametrize("iso, seconds", [("PT10M", 600), ("PT1H2M3S", 3723), ("PT45S", 45), ("P1DT1H", 90000), ("junk", None)])
def test_durations(spark, iso, seconds):
    assert one(spark, iso, research.duration_seconds) == seconds


def test_sanitiser(spark):
    text = "Plants grow [1]. See https://real.test/b. Also https://fake.test/x and [7], [9]."
    row = spark.createDataFrame([(text, [(1, "https://real.test/a"), (2, "https://real.test/b/")])], "t string, s array<struct<n:int,url:string>>")
    out, removed = research.sanitise_summary(F.col("t"), F.col("s"))
    assert tuple(row.select(out, removed).first()) == ("Plants grow [1]. See [2]. Also and , .", 3)


def test_pick_distinct(spark):
    assert one(spark, ["carbon cycle", "cycle", "light"], lambda t: keywords.pick_distinct(t), "array<string>") == ["carbon cycle", "light"]


@pytest.mark.parametrize("query, intent", [("quiz me", "quiz"), ("give me 5 practice problems", "practice"), ("research the latest findings", "research"), ("suggest good books", "resources"), ("I don't understand this", "doubt"), ("hello", "question"), ("resources in the document", "question")])
def test_rules(spark, query, intent):
    assert routing.route(spark.createDataFrame([(query,)], "query string")).first().intent == intent


def test_metrics(spark):
    row = spark.createDataFrame([("ATP stores energy", ["energy", "light"])], "a string, f array<string>").select(evaluate.fact_recall(F.col("a"), F.col("f"))).first()
    assert row[0] == 0.5
    assert one(spark, "The text does not mention it", evaluate.abstained) is True
    pair = spark.createDataFrame([(1, "a b c d", "a x c d")], "id long, c string, r string")
    assert evaluate.rouge_l(pair, "id", "c", "r").first().f1 == pytest.approx(0.75)
    assert evaluate.rouge_n(pair, "id", "c", "r", 1).first().f1 == pytest.approx(0.75)


def test_textrank_edges(spark):
    rows = spark.createDataFrame([(1, 0, "Only one sentence."), (2, 0, "the of"), (2, 1, "and is")], "doc_id long, position long, text string")
    got = {(r.doc_id, r.position): r.score for r in graph.textrank(rows).collect()}
    assert got == {(1, 0): 1.0, (2, 0): 0.5, (2, 1): 0.5}


def test_uploads_and_fallback(spark, tmp_path):
    assert one(spark, "a.PDF", lambda n: files.source_type(F.lit(""), n)) == "pdf"
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "ok �"
    found = connectors.fetch_results(spark.createDataFrame([(0, "q")], "query_idx long, query string"), [("p", lambda q: [{"title": q, "url": "u", "snippet": "s" * 600}])])
    assert len(found.first().snippet) == 500
    assert files.markdown_table(spark.createDataFrame([(1, 0.12345)], "a int, b double")) == "| a | b |\n| --- | --- |\n| 1 | 0.123 |"


def test_stream_rewrites_across_batches(spark, tmp_path):
    from lexmill.streaming.chat import rewritten_stream

    source = tmp_path / "in"
    spark.createDataFrame([("s", 1, "user", "What is osmosis?"), ("s", 2, "assistant", "Water."), ("s", 3, "user", "why?")], "session_id string, seq long, role string, content string").coalesce(1).write.parquet(str(source))
    rows = spark.readStream.schema("session_id string, seq long, role string, content string").parquet(str(source))
    q = rewritten_stream(rows, idle=None).writeStream.format("memory").queryName("rewrites").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert [r.retrieval_query for r in spark.table("rewrites").orderBy("seq").collect()] == ["What is osmosis?", "What is osmosis? why?"]


def test_classifier_keeps_all_features(spark):
    from lexmill.operators import routing

    rows = spark.createDataFrame([(" ".join(f"w{i}x{k}" for k in range(250)), "ab"[i % 2]) for i in range(20)], "query string, intent string")
    model = routing.classifier().fit(routing.balanced(rows))
    assert len(model.stages[4].vocabulary) == 20 * (250 + 249)
