"""Validation, length filters and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomset.functions.text import example_length, is_kept, within_bounds
from loomset.schema import Kind, OVER_LENGTH, PREFERENCE_KIND, QUALITY_MAX, QUALITY_MIN


def with_length(df: DataFrame, kind: Kind, name: str = "n") -> DataFrame:
    return df.withColumn(name, example_length(kind).cast("long"))


def drop_empty(df: DataFrame, kind: Kind, compat: bool = False) -> DataFrame:
    """Drop examples without content.

    ``compat`` keeps the historical gate for preferences: rows with one empty field
    go only if some row of the table is empty in all fields.
    """
    keep = is_kept(kind)
    if compat and kind is PREFERENCE_KIND:
        gate = df.agg(F.coalesce(F.bool_or(example_length(kind) == 0), F.lit(False)))
        return df.where(keep | ~gate.scalar())
    return df.where(keep)


def flag_over_length(df: DataFrame, kind: Kind, limit: int = OVER_LENGTH) -> DataFrame:
    return df.withColumn("over_length", example_length(kind) > limit)


def over_length_count(df: DataFrame, kind: Kind, limit: int = OVER_LENGTH) -> DataFrame:
    return df.agg(F.count_if(example_length(kind) > limit).alias("n"))


def validation_report(
    df: DataFrame, kind: Kind | None, limit: int = OVER_LENGTH, compat: bool = False
) -> DataFrame:
    """One pass over the table -> (issue, n); only issues that occur are listed.

    Issues: ``unknown_structure``, ``empty_removed``, ``empty_after_cleaning``, ``over_length``.
    ``compat`` counts preferences as the gated form of :func:`drop_empty` does.
    """
    if kind is None:
        return df.agg(F.count("*").alias("n")).select(F.lit("unknown_structure").alias("issue"), "n")
    length = example_length(kind)
    kept = F.count_if(is_kept(kind))
    empty = F.count_if(~is_kept(kind))
    if compat and kind is PREFERENCE_KIND:
        empty = F.count_if(length == 0)
        kept = F.when(empty > 0, kept).otherwise(F.count("*"))
    sums = df.agg(
        empty.alias("empty"), kept.alias("kept"), F.count_if(length > limit).alias("over")
    )
    return sums.select(
        F.stack(
            F.lit(3),
            F.lit("empty_removed"), F.col("empty"), F.col("empty") > 0,
            F.lit("empty_after_cleaning"), F.col("empty"), F.col("kept") == 0,
            F.lit("over_length"), F.col("over"), (F.col("over") > 0) & (F.col("kept") > 0),
        ).alias("issue", "n", "occurs")
    ).where("occurs").select("issue", "n")


def quality_filter(
    df: DataFrame, kind: Kind, low: int = QUALITY_MIN, high: int = QUALITY_MAX
) -> DataFrame:
    return df.where(within_bounds(kind, low, high))


def quality_report(
    df: DataFrame, kind: Kind, low: int = QUALITY_MIN, high: int = QUALITY_MAX
) -> DataFrame:
    """(original, removed, remaining) from one scan."""
    keep = F.coalesce(within_bounds(kind, low, high), F.lit(False))
    return df.agg(
        F.count("*").alias("original"),
        F.count_if(~keep).alias("removed"),
        F.count_if(keep).alias("remaining"),
    )
