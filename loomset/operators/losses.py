"""Training-loss records: logs, curves, final and best steps, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: evaluations without improvement after which training stops (0 is off).
PATIENCE = 3

STEP_BLOCK = 10_000  # steps per block of a run in the early-stopping scan


def present(records: DataFrame) -> DataFrame:
    """NaN losses, which loggers write for absent ones, as NULL."""
    number = lambda c: F.col(c).cast("double")
    return records.withColumns({c: F.when(~F.isnan(number(c)), F.col(c)) for c in ("train_loss", "eval_loss") if c in records.columns})


def loss_log(records: DataFrame, *keep: str) -> DataFrame:
    """Records that carry a training loss, losses to 4 places, a missing eval loss as NULL."""
    return present(records).where(F.col("train_loss").isNotNull()).select(
        *keep, "run_id", "step",
        F.round("train_loss", 4).alias("train_loss"), F.round("eval_loss", 4).alias("eval_loss"),
    )


def loss_curve(records: DataFrame) -> DataFrame:
    """(run_id, step, train_loss, eval_loss): training and evaluation records of a step merged."""
    return present(records).groupBy("run_id", "step").agg(
        F.round(F.max("train_loss"), 4).alias("train_loss"),
        F.round(F.max("eval_loss"), 4).alias("eval_loss"),
    )


def final_loss(records: DataFrame) -> DataFrame:
    """(run_id, step, train_loss) of the last record with a training loss."""
    logged = present(records).where(F.col("train_loss").isNotNull())
    return logged.groupBy("run_id").agg(
        F.max("step").alias("step"), F.round(F.max_by("train_loss", "step"), 4).alias("train_loss")
    )


def best_step(records: DataFrame) -> DataFrame:
    """(run_id, step, eval_loss) of the least eval loss, the earliest step if tied."""
    evals = present(records).where(F.col("eval_loss").isNotNull())
    best = evals.groupBy("run_id").agg(F.min(F.struct("eval_loss", "step")).alias("best"))
    return best.select("run_id", "best.step", F.round("best.eval_loss", 4).alias("eval_loss"))


def early_stop_step(records: DataFrame, patience: int = PATIENCE, block: int = STEP_BLOCK) -> DataFrame:
    """(run_id, stop_step): the first evaluation at which the loss had failed to improve
    ``patience`` times in a row. Runs that never stop, so all with ``patience`` 0, have no row.

    (run_id, step) is unique; an absent loss, NULL or NaN, is no evaluation, and a
    record without a run is of none. Runs are scanned in blocks of ``block`` steps, each a
    window partition of its own; what earlier blocks pass on (best loss, evaluation
    count, last improvement) is carried over one summary row per block, so a run of any
    length spreads over the cluster.
    """
    evals = present(records).where(F.col("eval_loss").isNotNull()).select(
        "run_id", "step", "eval_loss", F.floor(F.col("step") / block).alias("blk")
    )
    if patience <= 0:
        return evals.where(F.lit(False)).select("run_id", F.col("step").alias("stop_step"))
    in_block = Window.partitionBy("run_id", "blk").orderBy("step")
    earlier_rows = in_block.rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("run_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)

    carried = evals.groupBy("run_id", "blk").agg(F.min("eval_loss").alias("low"), F.count("*").alias("n")).select(
        "run_id", "blk",
        F.min("low").over(earlier_blocks).alias("low_before"),
        F.coalesce(F.sum("n").over(earlier_blocks), F.lit(0)).alias("n_before"),
    )
    best_before = F.least(F.min("eval_loss").over(earlier_rows), F.col("low_before"))
    nth = F.col("n_before") + F.row_number().over(in_block)
    marked = evals.join(carried, ["run_id", "blk"]).select(
        "run_id", "blk", "step", nth.alias("nth"),
        F.when(best_before.isNull() | (F.col("eval_loss") < best_before), nth).alias("improved"),
    )
    last_improved = marked.groupBy("run_id", "blk").agg(F.max("improved").alias("last")).select(
        "run_id", "blk", F.max("last").over(earlier_blocks).alias("last_before")
    )
    since = F.col("nth") - F.coalesce(F.max("improved").over(in_block), F.col("last_before"))
    counted = marked.join(last_improved, ["run_id", "blk"]).select("run_id", "step", since.alias("since"))
    return counted.where(F.col("since") >= patience).groupBy("run_id").agg(F.min("step").alias("stop_step"))
