"""File sources and sinks: uploads by type, text files, labelled CSV, question sets, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS

#: Types that uploads may have.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
ALLOWED = ("application/pdf", "image/png", "image/jpeg", "image/webp", "text/plain", "text/markdown")


def source_type(mime: Column, name: Column) -> Column:
    """pdf, image or text by MIME type or extension, in this order; else unknown."""
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    image = m.startswith("image/") | n.rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$")
    return F.when((m == "application/pdf") | n.endswith(".pdf"), "pdf").when(image, "image").when(m.startswith("text/") | n.rlike(r"\.(txt|md)$"), "text").otherwise("unknown")


def accepted_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (name, mime, size) of an allowed type, not empty and not too large."""
    return uploads.where(F.col("mime").isin(*ALLOWED) & (F.col("size") > 0) & (F.col("size") <= SETTINGS.max_upload_bytes))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole files, bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, page_number, text) of binary files through an injected page parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(parse(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, page_number int, text string")


def font_hints(spans: DataFrame) -> DataFrame:
    """(doc_id, line, size) of (doc_id, page, line_no, line, size): the largest span of a line, the
    last line of equal text."""
    lines = spans.groupBy("doc_id", "page", "line_no", F.trim("line").alias("line")).agg(F.max("size").alias("size"))
    return lines.where("line <> ''").groupBy("doc_id", "line").agg(F.max_by("size", F.struct("page", "line_no")).alias("size"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.routing import load_labelled

    return load_labelled(spark.read.csv(path, header=True, schema="query string, intent string"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of a JSON question set; answerable unless it says otherwise."""
    shape = "document string, note string, questions array<struct<id:string,question:string,answerable:boolean,relevant_phrases:array<string>,facts:array<string>,reference_answer:string>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select("document", F.explode("questions").alias("q"))
    return rows.select("document", "q.*").withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def write_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """CSV with a header, doubles rounded."""
    doubles = {n for n, t in df.dtypes if t in ("double", "float")}
    df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def markdown_table(df: DataFrame, places: int = 3, limit: int = 1000) -> str:
    """A small result as Markdown; refuses one of over ``limit`` rows."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    show = lambda v: f"{v:.{places}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def prompt_templates(files: DataFrame) -> DataFrame:
    """(name, template) of text files (path, text): those of a plain name, line ends as newlines."""
    name = F.regexp_extract("path", r"([^/\\]+)\.txt$", 1)
    told = files.select(name.alias("name"), F.regexp_replace("text", "\r\n", "\n").alias("template"))
    return told.where(F.col("name").rlike("(?i)^[a-z0-9_]+$"))


def load_prompts(spark: SparkSession, path: str) -> dict[str, str]:
    """The templates of a folder by name; a few short files, for ``operators.chat.render``."""
    files = read_texts(spark, f"{path.rstrip('/')}/*.txt").withColumnRenamed("doc_id", "path")
    return {r.name: r.template for r in prompt_templates(files).collect()}
