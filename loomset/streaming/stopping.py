"""Early stopping while logs arrive: one stop event a run, from keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomset.operators.losses import PATIENCE, present

# Fixed value: the session setting and the store that keeps arbitrary state.
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Stopping(StatefulProcessor):
    """Per run: the best loss, failures since, whether it has stopped, and evaluations not yet in order.

    An evaluation waits until the watermark has passed its time, as earlier steps may still come; a
    timer at the earliest waiting time then takes what has become due in order of steps.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "best double, failures int, stopped boolean")
        self.waiting = handle.getValueState("waiting", "steps array<bigint>, losses array<double>, times array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = ("step", "eval_loss", "ms")
        # Whole numbers beside a NULL come as fractions.
        new = [(int(s), x, int(t)) for frame in rows for s, x, t in zip(*(frame[c].tolist() for c in columns)) if x == x]
        if new and not (self.progress.exists() and self.progress.get()[2]):
            earlier = self._waiting()
            self._wait(earlier + new)
            if not earlier or min(t for _, _, t in new) < min(t for _, _, t in earlier):
                self.handle.registerTimer(min(t for _, _, t in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = self._waiting()
        due = sorted(w for w in waiting if w[2] <= passed)
        best, failures, stopped = self.progress.get() if self.progress.exists() else (None, 0, False)
        stop = None
        for step, loss, _ in due:
            if stopped:
                break
            if best is None or loss < best:
                best, failures = loss, 0
            else:
                failures += 1
            if failures >= self.patience:
                stop, stopped = step, True
        self.progress.update((best, failures, stopped))
        rest = [] if stopped else [w for w in waiting if w[2] > passed]
        self._wait(rest)
        if rest:
            self.handle.registerTimer(min(t for _, _, t in rest))
        if stop is not None:
            yield pd.DataFrame({"run": [key[0]], "stop_step": [stop]})

    def _waiting(self) -> list[tuple[int, float, int]]:
        return list(zip(*(list(c) for c in self.waiting.get()))) if self.waiting.exists() else []

    def _wait(self, rows: list[tuple[int, float, int]]) -> None:
        if rows:
            steps, losses, times = zip(*rows)
            self.waiting.update((list(steps), list(losses), list(times)))
        elif self.waiting.exists():
            self.waiting.clear()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary keyed state needs this store; it keeps state on disk, so that it need not fit the heap."""
    spark.conf.set(STORE_KEY, STORE)


def early_stops(records: DataFrame, patience: int = PATIENCE, late: str = "10 minutes") -> DataFrame:
    """(run_id, stop_step) once per run, as :func:`loomset.operators.losses.early_stop_step` has it.

    Records may come up to ``late`` behind the newest ``ts``, within which those of a run are put in
    order of their steps; steps and times of a run rise together. Runs whose watermark has not passed are
    open: a record without losses of a later time (:func:`closing`) ends bounded input. Records without a run stop nothing; with ``patience`` 0 no run stops.
    """
    use_state_store(records.sparkSession)
    # As text and never NULL: pandas turns whole numbers beside a NULL into other keys.
    run = F.when(F.col("run_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("run_id").cast("string")))
    # Records without a run stay in, as those that close a log move the watermark.
    evals = present(records).where(F.col("eval_loss").isNotNull() | F.col("run_id").isNull()).withWatermark("ts", late).select(
        run.alias("run"), "step", F.col("eval_loss").cast("double").alias("eval_loss"), "ts", F.unix_millis("ts").alias("ms")
    )
    stops = evals.groupBy("run").transformWithStateInPandas(_Stopping(patience), "run string, stop_step bigint", "Append", "EventTime")
    run_id = F.substring("run", 2, 1 << 30).cast(records.schema["run_id"].dataType)
    return stops.where(F.lit(patience > 0) & (F.col("run") != "-")).select(run_id.alias("run_id"), "stop_step")


def closing(records: DataFrame, after: str = "2200-01-01") -> DataFrame:
    """One record, shaped as ``records``, of a time behind all others, that moves the watermark and says nothing else."""
    spark = records.sparkSession
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema if f.name != "ts"]
    return spark.range(1).select(*empty, F.lit(after).cast("timestamp").alias("ts")).select(*records.columns)
