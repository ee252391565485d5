"""The opN queries and the pipeline on whole small tables."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": "doc_id n_words n_base first_word last_word base_labels labels score", "op2": "doc_id fingerprint component_id", "op3": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4": "doc_id item_id", "op5": "page_id url text n_chars", "op6": "doc_id n_assign n_access n_hex base_sha256 spans", "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query(spark, sf, name):
    out = QUERIES[name](spark, sf)
    op = name.split("_")[0]
    assert set(COLUMNS[op].split()) <= set(out.columns)
    rows = spark.read.parquet(f"{sf}/{'pages' if op == 'op5' else 'documents'}.parquet").count()
    assert out.count() == rows if op not in ("op4", "op9") else out.count() > 0


def test_stages_keep_columns_and_act(spark, sf, tmp_path):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    planted = [(90_001, "1234 5678 !!!", "en", "s", 13), (90_002, None, "en", "s", None), (90_003, base.first().text, "en", "s", 1), (90_004, f"Some words first. {item} And after.", "en", "s", 1), (90_005, "Write to me at some.body@mail.example.com for the rest of it", "en", "s", 1)]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        out = stage(spark, docs, sf)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == base.columns
            gone = {"language": {90_001, 90_002}, "near_duplicates": {90_003}, "decontaminate": {90_004}, "personal_data": set()}[name]
            left = {r.doc_id for r in out.collect()}
            assert not gone & left and (name == "personal_data" or left | gone <= {r.doc_id for r in docs.collect()})
            assert name != "language" or {r.doc_id for r in docs.collect()} - left == gone
        if name == "personal_data":
            row = out.where("doc_id = 90005").first()
            assert "[EMAIL]" in row.text and row.n_chars == len(row.text)
        docs, before = out, docs
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Documents of nulls, blanks, repeats and bits that almost match."""
    rng = random.Random(8)
    bits = ["a@b.co", "@", ".", "x_", "+", "1", "23", "255.", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (504) 555-2652", " ", "-", "\u00e9", "(", "\U0001F600", "CC", " by ", "All rights", " reserved", "\n"]
    bits += ["token: abcdefgh", "PassWord='xyz", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "api_key", "=", '"', "secret", ":", "hunter2hunter2", "general public ", "License"]
    texts = [None, "", " \n", "x" * 50_000, "1 " * 3000, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500))]
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "no id: a@b.co")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_base_columns_are_those_of_sql(spark, sf, odd_tables, name):
    for folder, files in ((sf, "documents.parquet"), (odd_tables, "documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{files}'")
        out = QUERIES[name](spark, folder)
        cols = sorted(out.columns)
        ours = Counter(tuple(r) for r in out.select(*cols).collect())
        theirs = Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
        assert sum(ours.values()) > 100 and ours == theirs


def test_stages_of_empty_and_repeated_rows(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([(1, None, None, None, None)] * 2, base.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.where("false"), sf).count() == 0
        assert stage(spark, none, sf).count() == {"language": 0, "near_duplicates": 1}.get(name, 2)
