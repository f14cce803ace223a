"""Which format a file name stands for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix -> format, tested in this order against the lower-case file name.
SUFFIXES = {
    ".csv": "csv", ".jsonl": "jsonl", ".json": "json", ".txt": "txt", ".xlsx": "excel", ".pdf": "pdf",
}


class UnsupportedFormat(ValueError):
    """No reader for the file."""


def detect_format(path: str) -> str | None:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return next((f for suffix, f in SUFFIXES.items() if name.endswith(suffix)), None)


def format_of(path: Column) -> Column:
    """The same for a column of paths."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.coalesce(*[F.when(F.endswith(name, F.lit(s)), F.lit(f)) for s, f in SUFFIXES.items()])
