"""Row-wise text operators over Arrow batches; ids pass through untouched, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

#: Texts in, then the rows that the results belong to (None: each row once) and the result columns.
Mapper = Callable[[list[str | None]], tuple[list[int] | None, list[Any]]]


def map_texts(df: DataFrame, id_col: str, text_col: str, setup: Callable[[], Mapper], schema: str) -> DataFrame:
    """Apply a mapper, made once in each task, to all texts; ``schema`` is that of its columns."""
    fields = [f.split() for f in schema.split(", ")]
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = ["_id", *(f[0] for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = setup()
        for batch in batches:
            rows, columns = mapper(batch.column(1).to_pylist())
            ids = batch.column(0) if rows is None else batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, _TYPES[f[1]]) for f, c in zip(fields, columns))], names)

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def columns_of(rows: list[tuple], width: int) -> list[list]:
    """Rows as columns, for none as well."""
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]
