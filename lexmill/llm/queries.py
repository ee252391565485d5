"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base_sql, langid
from .decontam import find_leaks
from .htmlcrf import extract_text
from .lattice_lm import score
from .licenses import license_scan
from .media import media_columns
from .packing import pack_documents
from .pii import base_columns, private_spans
from .runtime import table
from .secret_scan import secrets
from .simhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_html")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.coalesce(langid.fold("doc_id", 4) != 2, F.lit(True))))
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "n_spans")


@query("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold("doc_id", 5) == 1, F.lit(False))
    # The fold goes by the id alone, so it can be told again from the result.
    return score(docs, ~held_out).withColumn("held_out", held_out)


@query("op9_pack")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), size=1024)


@query("op10_media")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


@query("base_licenses", base_sql.LICENSES)
def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1's contract fixes in every detail; so for the next three."""
    return op1(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query("base_private", base_sql.PRIVATE)
def base_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_columns(table(spark, sf_dir, "documents"))


@query("base_secrets", base_sql.SECRETS)
def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


@query("base_media", base_sql.MEDIA)
def base_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
