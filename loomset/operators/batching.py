"""Global row numbers and fixed-size batches, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomset.runtime import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these bits


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Add the 0-based rank of each row by the unique ``order`` columns.

    Range-partition, sort inside the partitions, number locally, then shift by the
    sizes of the partitions before (one broadcast row per shuffle partition). The
    numbered table is written first: range bounds could differ on recomputation.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = materialise(
        placed.select(
            *df.columns,
            F.shiftright("_at", _LOCAL_BITS).alias("_part"),
            F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"),
        ),
        "ordinal",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_local")).alias(name)
    )


def assign_batches(df: DataFrame, *order: str, size: int = 8) -> DataFrame:
    """Add ``batch_id``: rows [i * size, (i + 1) * size) by ``order`` form batch i."""
    return with_ordinal(df, *order, name="_ordinal").select(
        *df.columns, F.floor(F.col("_ordinal") / size).cast("long").alias("batch_id")
    )


def reported_batches(rows: int, size: int) -> int:
    """The batch count a progress display shows: whole batches, at least one."""
    return max(1, rows // size)
