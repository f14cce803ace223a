"""Whole tables written to the shared folder in the formats the readers take."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomset.runtime import scratch_path
from loomset.sinks.writers import write_csv


def csv_export(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "export.csv")
    write_csv(df, path)
    return path


def jsonl_export(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "export.jsonl")
    df.write.option("ignoreNullFields", False).json(path)
    return path


def json_array_export(df: DataFrame) -> str:
    """A top-level array per partition, written line by line."""

    def bracketed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for frame in frames:
            if len(frame):
                lines = frame["value"].radd(",")
                lines.iloc[0] = lead + frame["value"].iloc[0]
                lead = ","
                yield lines.to_frame()
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    path = scratch_path(df.sparkSession, "export.json")
    objects = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    objects.mapInPandas(bracketed, "value string").write.text(path)
    return path


def text_export(df: DataFrame, column: str) -> str:
    path = scratch_path(df.sparkSession, "export.txt")
    df.select(column).write.text(path)
    return path
