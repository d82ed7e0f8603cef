"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive pieces of about `most` in total; an item larger than that is a piece of its own."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def literal_rows(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of texts as part of the plan: no Python worker is started for it."""
    items = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*items)))
