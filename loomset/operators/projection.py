"""Column mapping, schema-kind resolution and string projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from loomset.schema import (
    CHOSEN, INSTRUCTION, INSTRUCTION_KIND, Kind, OUTPUT, PREFERENCE_KIND, PROMPT, REJECTED, REWARD_KIND, TEXT,
    TEXT_KIND,
)


class SchemaError(ValueError):
    """The columns of a table fit no known kind."""


class UnmappedColumns(SchemaError):
    """No column has a name that implies a kind: some have to be mapped."""

    def __init__(self, need: str, columns: list[str]):
        super().__init__(f"need columns {need}; found {columns}; map them first")
        self.columns = columns


def build_mapping(first: str | None, second: str | None, third: str | None, preference: bool = False) -> dict[str, str]:
    """Column picks -> rename map.

    Preferences need all three picks (prompt, chosen, rejected). Otherwise the first two
    picks name instruction and output, or the third names text.
    """
    if preference:
        picks = {first: PROMPT, second: CHOSEN, third: REJECTED}
        return picks if all((first, second, third)) else {}
    if first and second:
        return {first: INSTRUCTION, second: OUTPUT}
    return {third: TEXT} if third else {}


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def resolve_kind(columns: Iterable[str], preference: bool = False) -> Kind | None:
    """The kind the column names imply; None if unmapped.

    Instruction pairs win over text. Preferences without a prompt are of the reward kind.
    """
    have = set(columns)
    order = (PREFERENCE_KIND, REWARD_KIND) if preference else (INSTRUCTION_KIND, TEXT_KIND)
    return next((k for k in order if have.issuperset(k.columns)), None)


def require_kind(columns: Iterable[str], preference: bool = False) -> Kind:
    columns = list(columns)
    kind = resolve_kind(columns, preference)
    if kind is None:
        need = "chosen and rejected, and prompt unless for rewards," if preference else "instruction and output, or text"
        raise UnmappedColumns(need, columns)
    return kind


def stringify(df: DataFrame, kind: Kind, *keep: str, null_token: str | None = None) -> DataFrame:
    """Keep ``keep`` and the kind's columns, the latter as strings; NULL becomes ``null_token`` if given."""

    def as_text(name: str):
        text = F.col(name).cast("string")
        return (F.coalesce(text, F.lit(null_token)) if null_token is not None else text).alias(name)

    return df.select(*keep, *[as_text(c) for c in kind.columns])


def resolve_prompt(df: DataFrame) -> DataFrame:
    """Make sure there is a ``prompt`` column, renaming text or instruction if need be."""
    for name in (PROMPT, TEXT, INSTRUCTION):
        if name in df.columns:
            return df.withColumnRenamed(name, PROMPT)
    raise SchemaError(f"need a prompt, text or instruction column; found {df.columns}")
