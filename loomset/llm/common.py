"""Helpers of the corpus operators: digests, bounded broadcasts, labels; hot keys and salted joins are of the runtime."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.runtime import HOT_KEYS, HOT_ROWS, SALTS, hot_keys, salted_join  # noqa: F401

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
SLICE_ROWS = 64  # rows that a task turns into Python values at once


def text_of(name: str = "text") -> Column:
    """The whole text, a NULL text being empty."""
    return F.coalesce(F.col(name), F.lit(""))


def digest(text: Column) -> Column:
    """Content address: lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def small(df: DataFrame, size: Column) -> bool:
    """Whether ``df`` may be broadcast: its rows and the sum of ``size`` (bytes a row) are both bounded."""
    rows, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def slices(column: pa.Array, rows: int = SLICE_ROWS) -> Iterator[list]:
    """The values of an Arrow column, a few rows at a time, so that few texts are Python objects at once."""
    for start in range(0, len(column), rows):
        yield column.slice(start, rows).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
