"""What SQL can't say, against plain Python; and properties of the trained operators."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import analyze, cleaning, evaluate, graph, keywords, retrieval, routing, topics
from lexmill.operators.weights import SEPARATOR, weigh
from lexmill.plans import QUERIES
from lexmill.sources import files, images

MARKS = str.maketrans({k: v for k, v in cleaning.MARKS.items()})


def plain(text):
    return re.sub(cleaning.CONTROL, "", unicodedata.normalize("NFKC", text).translate(MARKS))


def test_clean_unicode(spark, sf):
    odd = [(1, "ﬁne ½ Å x\x07y ‘q’ – ﻿end"), (2, ""), (3, None)] + [(r.doc_id + 10, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(odd, "id long, text string")
    got = {r.id: r.t for r in df.select("id", cleaning.plain_marks(cleaning.nfkc(F.col("text"))).alias("t")).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in odd}


def brute_pages(pages):
    """Cleaned text of one book, step by step."""
    pages = [plain(t).split("\n") for t in pages]
    sides = Counter()
    key = lambda x: re.sub(r"\d+", "#", x.strip(" \t\n\x0b\f\r").lower())
    for p in pages:
        filled = [x for x in p if x.strip(" \t\n\x0b\f\r")]
        sides.update(("top", key(x)) for x in filled[:3])
        sides.update(("bottom", key(x)) for x in filled[-3:])
    gone = {k for (_, k), c in sides.items() if len(pages) >= 3 and c / len(pages) >= 0.4}
    text = "\n\n".join("\n".join("" if re.match(cleaning.PAGE_NUMBER, x) else x for x in p if not (x.strip() and key(x) in gone)) for p in pages)
    text = re.sub(r"(?<=\w)-\n(?=\w)", "", text)
    out, held = [], None
    for line in (x.rstrip(" \t\n\x0b\f\r") for x in text.split("\n")):
        if held is None:
            held = line
        elif not line.strip() or not held.strip() or re.search(cleaning.ENDS_CLAUSE, held) or re.match(cleaning.OPENS_ITEM, line) or re.match(cleaning.CAPS_LINE, held):
            out.append(held)
            held = line
        else:
            held = held.rstrip() + " " + line.lstrip()
    lines = [x.strip(" \t\n\x0b\f\r") for x in re.sub("[ \t]+", " ", "\n".join([*out, held])).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip(" \t\n\x0b\f\r")


def test_clean_pages(spark):
    book = ["ANNUAL REPORT 2020\nThe auto-\nmatic gener-\nation of text is\na common task\nPage 1 of 3", "Annual Report 2021\nINTRODUCTION\nIt works well.\n- item\n  Page 2 of 3  ", "annual report 2022\nlast words,\nnothing  more\niv\n\n\n\nend ½\nPage 3 of 3"]
    rows = [("a", i, t) for i, t in enumerate(book)] + [("b", 0, "one page\nonly"), ("c", 0, "")]
    got = {r.doc_id: r.cleaned_text for r in cleaning.clean_pages(spark.createDataFrame(rows, "doc_id string, page_number long, text string")).collect()}
    assert got == {"a": brute_pages(book), "b": "one page only", "c": ""} and "automatic generation of text is a common task" in got["a"]


def test_rouge_l(spark, sf):
    docs = [r.text[:400] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").limit(24).collect()]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(docs, docs[1:]))] + [(98, "", "x"), (99, "a b c", "a x c")]

    def f1(c, r):
        a, b = re.findall("[a-z0-9]+", c.lower()), re.findall("[a-z0-9]+", r.lower())
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return 2 * t[-1, -1] / (len(a) + len(b)) if a and b else 0.0

    got = {r.id: r.f1 for r in evaluate.rouge_l(spark.createDataFrame(pairs, "id long, c string, r string"), "id", "c", "r").collect()}
    assert got == pytest.approx({i: f1(c, r) for i, c, r in pairs})


def test_weights_against_a_matrix():
    rng = np.random.default_rng(1)
    texts = [SEPARATOR.join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(12)]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in (t.split(SEPARATOR) if t else [] for t in texts)]
    total = Counter(g for w in grams for g in w)
    kept = sorted(total, key=lambda g: (-total[g], g))[:10]
    df = {g: sum(g in w for w in grams) for g in kept}
    rows = [{g: w.count(g) * (np.log(13 / (1 + df[g])) + 1) for g in kept if g in w} for w in grams]
    want = {(i, g): v / np.sqrt(sum(x * x for x in r.values())) for i, r in enumerate(rows) for g, v in r.items()}
    w = weigh(texts, True, 10)
    assert {(p, w.vocabulary[t]): v for p, t, v in zip(w.part.tolist(), w.term.tolist(), w.weight.tolist())} == pytest.approx(want)


def test_similarities_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    w = weigh([SEPARATOR.join(rng.choice([f"w{i}" for i in range(30)], 8)) for _ in range(40)], False, None)
    whole = sorted(zip(*(x.tolist() for x in graph.similarities(w))))
    monkeypatch.setattr(graph, "_CELLS", 100)
    assert sorted(zip(*(x.tolist() for x in graph.similarities(w)))) == whole and len(whole) > 50
    dense = np.zeros((w.parts, len(w.vocabulary)))
    dense[w.part, w.term] = w.weight
    a, b = np.nonzero(np.triu(np.round(dense @ dense.T, 9) >= graph.LEAST_SIMILARITY, 1))
    assert [(x, y) for x, y, _ in whole] == list(zip(a.tolist(), b.tolist()))


def test_analysis_is_consistent(spark):
    text = "1. Overview\n" + " ".join(f"Plants use light number {i} to make sugar and water again." for i in range(60))
    a = analyze.analyze(spark.createDataFrame([(1, text), (2, "One sentence only."), (3, ""), (4, None)], "doc_id long, text string"))
    chunk, rows = a.chunks.collect(), a.sentence_importance.collect()
    assert {r.doc_id for r in chunk} == {1, 2} == {r.doc_id for r in rows} and a.warnings and a.embedding_model == keywords.FALLBACK_MODEL
    assert {r.chunk_id for r in rows if r.doc_id == 1} <= {r.chunk_id for r in chunk if r.doc_id == 1} and all(0 <= r.score <= 1 for r in rows)
    assert a.summary.where("doc_id = 1").count() == 5 and max(r.f_textrank for r in rows if r.doc_id == 1) == 1.0
    vectors, model, warnings = keywords.embed(spark.createDataFrame([(1, ["a", "bb"])], "doc_id long, texts array<string>"), lambda texts: [[len(t)] for t in texts], "m")
    assert [(r.part, r.vector) for r in vectors.orderBy("part").collect()] == [(0, [1.0]), (1, [2.0])] and (model, warnings) == ("m", [])


def test_dense_cosines(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(40, 5)), rng.normal(size=(6, 5))
    v[0] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(9, None)], "query_id long, vector array<double>")
    norm = lambda m: m / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None]
    want = np.clip(norm(q) @ norm(v).T, 0, 1)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    got = {(r.query_id, r.doc_id): r.cosine for r in retrieval.dense_cosines(vectors, asked).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(6) for j in range(40)}, abs=1e-8)
    best = defaultdict(list)
    for r in retrieval.dense_cosines(vectors, asked, 3).collect():
        best[r.query_id].append(r.cosine)
    assert all(sorted(best[i])[-3:] == pytest.approx(sorted(np.round(want[i], 9))[-3:]) for i in range(6))
    assert retrieval.dense_cosines(vectors, asked.where("vector IS NULL")).count() == 0


def test_topics_part_clear_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(k * 20 + i, (np.eye(3)[k] * 10 + rng.normal(size=3) * 0.1).tolist()) for k in range(3) for i in range(20)]
    out = {r.item_id: r.topic for r in topics.cluster(spark.createDataFrame(rows, "item_id long, vector array<double>")).collect()}
    assert len({(k, out[k * 20 + i]) for k in range(3) for i in range(20)}) == 3 == len(set(out.values()))
    assert {r.topic for r in topics.cluster(spark.createDataFrame(rows[:2], "item_id long, vector array<double>")).collect()} == {0}


def test_classifier_learns_and_folds_are_even(spark):
    rows = [(i, ("quiz me on topic " if i % 3 else "what does this mean in ") + f"number {i}", "quiz" if i % 3 else "question") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, query string, intent string")
    model = routing.classifier().fit(routing.balanced(df))
    probs = {r.id: r.probs for r in routing.probabilities(model, df.select("id", "query")).collect()}
    assert all(max(probs[i], key=probs[i].get) == intent for i, _, intent in rows) and all(0.9 < sum(p.values()) < 1 + 1e-9 for p in probs.values())  # an unseen label keeps a share
    folds = Counter((r.intent, r.fold) for r in routing.stratified_folds(df, "intent", "id").collect())
    assert sorted(folds.values()) == [4] * 5 + [8] * 5
    out = routing.cross_validate(routing.stratified_folds(df, "intent", "id", 2), "intent", "query", 2).collect()
    assert [r.n for r in out] == [30, 30] and all(r.accuracy == 1.0 for r in out)


def test_topics_of_embeddings(spark, sf):
    out = QUERIES["topics_kmeans"](spark, sf)
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count() == len({r.item_id for r in rows}) and 2 <= len({r.topic for r in rows}) <= 8


def test_images(spark, tmp_path):
    page = np.full((60, 90), 240.0)
    for k in range(6):
        page[10 + 7 * k : 12 + 7 * k, 10:80] = 20
    assert set(np.unique(images.prepared(np.dstack([page] * 3)))) <= {0, 255} and images.zoom(144) == 2
    assert images.thresholded(page)[10, 40] == 0 and images.thresholded(page)[3, 40] == 255
    line = np.full((101, 101), 255.0)
    line[50, 10:90] = 0
    lean = images.turned(line, 10)
    assert abs(abs(images.skew(lean)) - 10) < 1.5 and abs(images.skew(images.turned(lean, images.skew(lean)))) < 2 and images.skew(images.turned(line, 60)) == 0.0
    (tmp_path / "a.img").write_bytes(b"ok")
    (tmp_path / "b.img").write_bytes(b"broken")
    decode = lambda b: page if b == b"ok" else None
    rows = sorted(images.read_images(spark, str(tmp_path / "*.img"), decode, [("e", lambda x: (f"{x.shape[0]} rows", 0.9)), ("t", lambda x: ("", 0.1))]).collect())
    assert [(r.engine, r.text, r.confidence, r.warning) for r in rows] == [("e", "60 rows", 0.9, None), ("t", "", 0.1, None), ("none", "", 0.0, "could not decode image file")]


def test_prompts_from_files(spark, tmp_path):
    (tmp_path / "quiz_mode.txt").write_bytes(b"a {{x}}\r\nb")
    (tmp_path / "not-one.txt").write_bytes(b"c")
    assert files.load_prompts(spark, str(tmp_path)) == {"quiz_mode": "a {{x}}\nb"}


def test_question_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"document": "d", "questions": [{"id": "1", "question": "q?", "facts": ["f"]}, {"id": "2", "question": "x?", "answerable": false}]}')
    assert [(r.id, r.answerable, r.facts) for r in files.read_questions(spark, str(tmp_path / "q.json")).orderBy("id").collect()] == [("1", True, ["f"]), ("2", False, None)]


def test_pages_and_saved_models(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    pages = files.read_pages(spark, str(tmp_path / "a.pdf"), lambda b: b.decode().split("|")).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "one"), (2, "two")]
    df = spark.createDataFrame([("a b", "quiz"), ("c d", "question")] * 4, "query string, intent string")
    made = []
    train = lambda: made.append(1) or routing.classifier().fit(routing.balanced(df))
    first, again = (routing.load_model(spark, str(tmp_path / "model"), train) for _ in range(2))
    assert len(made) == 1 and first.stages[0].labels == again.stages[0].labels
