"""Head rows of a table, plain or formatted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomset.schema import INSTRUCTION_KIND, Kind, PREFERENCE_KIND, REWARD_KIND


# Labels of the formatted preview, the rule between examples.
PREFERENCE_LABELS = ("**Prompt:** ", "\n**✅ Chosen:** ", "\n**❌ Rejected:** ")
REWARD_LABELS = ("**✅ Chosen:** ", "\n**❌ Rejected:** ")
INSTRUCTION_LABELS = ("**Instruction:** ", "\n**Output:** ")
RULE = "\n\n---\n\n"

EMPTY_STATUS = "Nothing left to show: no row has content."


def preview(df: DataFrame, kind: Kind, order: str, n: int | None = None) -> DataFrame:
    """The first rows by ``order``: 10 for text, 5 for the other kinds."""
    rows = kind.preview_rows if n is None else n
    return df.select(order, *kind.columns).orderBy(order).limit(rows)


def preview_or_status(df: DataFrame, kind: Kind, order: str) -> DataFrame:
    """The preview, or one status row when there is nothing to show."""
    head = preview(df, kind, order)
    return df.sparkSession.createDataFrame([(EMPTY_STATUS,)], "Status string") if head.isEmpty() else head


def preview_formatted(df: DataFrame, kind: Kind, order: str) -> DataFrame:
    """(order, preview): labelled examples; 3 for preferences, 5 for the other kinds."""
    labels = {
        PREFERENCE_KIND: PREFERENCE_LABELS, REWARD_KIND: REWARD_LABELS, INSTRUCTION_KIND: INSTRUCTION_LABELS
    }.get(kind, ("",))
    shown = F.concat(
        *[F.concat(F.lit(label), F.coalesce(F.col(c), F.lit(""))) for label, c in zip(labels, kind.columns)]
    )
    head = preview(df, kind, order, 3 if kind in (PREFERENCE_KIND, REWARD_KIND) else 5)
    return head.select(order, shown.alias("preview"))


def joined_preview(formatted: DataFrame, order: str) -> DataFrame:
    """The formatted examples of one preview (a handful of rows) as one text, ruled apart."""
    pairs = F.sort_array(F.collect_list(F.struct(order, "preview")))
    return formatted.agg(
        F.array_join(F.transform(pairs, lambda p: p["preview"]), RULE).alias("preview")
    )
