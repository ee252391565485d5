"""Snippets of DuckDB SQL that the query twins share, and inline relations for both engines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexical import CONTENT_STOP, RAW_TOKEN, RETRIEVAL_STOP, SUFFIXES


def text(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(text, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]"}


class Inline:
    """A small relation that is identical in both engines."""

    def __init__(self, schema: str, rows: Iterable[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.fields = [f.split() for f in schema.split(", ")]

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema.replace("long", "bigint"))

    @property
    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {_TYPES[k]}) AS {n}" for n, k in self.fields)
        return f"(SELECT {casts} FROM (VALUES {rows}) AS _v({', '.join(n for n, _ in self.fields)}))"


def in_list(x: str, words: Iterable[str]) -> str:
    return f"{x} IN ({', '.join(text(w) for w in words)})"


def stem(w: str) -> str:
    rules = [f"WHEN length({w}) <= 3 OR regexp_full_match({w}, '[0-9]+') THEN {w}", f"WHEN ends_with({w}, 'sses') THEN left({w}, length({w}) - 2)", f"WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'"]
    rules += [f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})" for s in SUFFIXES]
    rules.append(f"WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND NOT ends_with({w}, 'us') AND NOT ends_with({w}, 'is') THEN left({w}, length({w}) - 1)")
    return f"(CASE {' '.join(rules)} ELSE {w} END)"


def tokens(x: str) -> str:
    raw = f"regexp_extract_all(lower({x}), {text(RAW_TOKEN)})"
    word = "split_part(r, '''', 1)"
    kept = f"NOT {in_list(word, RETRIEVAL_STOP)} AND NOT {in_list('r', RETRIEVAL_STOP)} AND (length({word}) > 1 OR regexp_full_match({word}, '[0-9]'))"
    return f"list_transform(list_filter({raw}, lambda r: {kept}), lambda r: {stem(word)})"


def content_stems(x: str) -> str:
    kept = f"NOT {in_list('w', CONTENT_STOP)} AND (length(w) > 1 OR regexp_matches(w, '[0-9]'))"
    return f"list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: {kept}), lambda w: {stem('w')})"
