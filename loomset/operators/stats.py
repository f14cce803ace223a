"""Dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomset.functions.text import example_length
from loomset.schema import Kind


def dataset_stats(df: DataFrame, kind: Kind) -> DataFrame:
    """(kind, num_examples, avg_length); the mean of an empty table is 0."""
    return df.agg(
        F.count("*").alias("num_examples"),
        F.round(F.coalesce(F.avg(example_length(kind)), F.lit(0.0)), 4).alias("avg_length"),
    ).select(F.lit(kind.name).alias("kind"), "num_examples", "avg_length")


def length_stats(df: DataFrame, kind: Kind, *by: str) -> DataFrame:
    """Count, mean, least and greatest length, optionally per group."""
    length = example_length(kind)
    return df.groupBy(*by).agg(
        F.count("*").alias("num_examples"),
        F.round(F.coalesce(F.avg(length), F.lit(0.0)), 4).alias("avg_length"),
        F.min(length).cast("long").alias("min_length"),
        F.max(length).cast("long").alias("max_length"),
    )
