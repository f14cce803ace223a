"""Tables derived from the driver's parquet, in the shapes the operators accept.

Each function has a twin of the same name in ``oracles.CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.functions.text import tokens
from loomset.runtime import balance

TURN_BITS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def heavy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is costly per row."""
    return balance(documents(spark, sf_dir))


def pair_id(conv_id: Column, turn: Column) -> Column:
    """Conversation and turn in one number; an error if either does not fit its half."""
    fits = conv_id.between(0, (1 << 63 - TURN_BITS) - 1) & turn.between(0, (1 << TURN_BITS) - 1)
    return F.when(fits, F.shiftleft(conv_id, TURN_BITS) + turn).otherwise(F.raise_error(F.lit("conversation or turn out of range")))


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, instruction, output): each user turn answered by the assistant's next turn.

    Turns are numbered without gaps, so "next" is an equi-join that spreads even one
    very long conversation over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next"), F.col("text").alias("instruction")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "next"]).select(
        pair_id(F.col("conv_id"), F.col("turn")).alias("row_id"), "instruction", "output"
    )


def conv_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, prompt, chosen, rejected): rejected is the next conversation's answer at the same turn, else the prompt."""
    pairs = conv_pairs(spark, sf_dir)
    others = pairs.select((F.col("row_id") - (1 << TURN_BITS)).alias("row_id"), F.col("output").alias("other"))
    return pairs.join(others, "row_id", "left").select(
        "row_id",
        F.col("instruction").alias("prompt"),
        F.col("output").alias("chosen"),
        F.coalesce("other", "instruction").alias("rejected"),
    )


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, prompt, reference, prediction): references with words dropped by hash.

    Half of the predictions have their halves swapped, and one in sixteen is empty.
    """
    row = F.col("row_id").cast("string")
    digit = lambda c, i: F.substring(F.md5(c), i, 1)
    kept = F.filter(
        tokens("reference"), lambda _, i: digit(F.concat(row, F.lit("-"), i.cast("string")), 1) > "4"
    )
    half = F.floor(F.size("kept") / 2).cast("int")
    swapped = F.concat(F.slice("kept", half + 1, F.size("kept")), F.slice("kept", F.lit(1), half))
    return (
        conv_pairs(spark, sf_dir)
        .select("row_id", F.col("instruction").alias("prompt"), F.col("output").alias("reference"))
        .withColumn("kept", kept)
        .select(
            "row_id", "prompt", "reference",
            F.when(digit(row, 1) == "0", "")
            .when(digit(row, 2) >= "8", F.array_join(swapped, " "))
            .otherwise(F.array_join("kept", " "))
            .alias("prediction"),
        )
    )


def _blank(name: str, when: Column) -> Column:
    return F.when(when, "").otherwise(F.col(name)).alias(name)


def documents_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every short text emptied."""
    return documents(spark, sf_dir).select("doc_id", _blank("text", F.length("text") < 100))


def pairs_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with short fields emptied; some rows lose both."""
    short = lambda c: F.length(c) < 400
    return conv_pairs(spark, sf_dir).select(
        "row_id", _blank("instruction", short("instruction")), _blank("output", short("output"))
    )


def prefs_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences with short fields emptied; some rows lose all three."""
    short = lambda c: F.length(c) < 250
    return conv_prefs(spark, sf_dir).select(
        "row_id",
        *[_blank(c, short(c)) for c in ("prompt", "chosen", "rejected")],
    )


def emb_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, side, pos, vec): sixty vectors make a pair; every third pair has one side only."""
    v = F.col("vec_id")
    pair = F.floor(v / 60).cast("long")
    return table(spark, sf_dir, "embeddings").select(
        pair.alias("pair_id"), F.when((v % 2 == 0) | (pair % 3 == 2), "pred").otherwise("ref").alias("side"),
        v.alias("pos"), F.col("embedding").alias("vec"),
    )


def emb_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, side, pos, vec): ten vectors make a pair, five on each side."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 10).cast("long").alias("pair_id"),
        F.when(v % 10 < 5, "pred").otherwise("ref").alias("side"),
        (v % 5).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def train_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, train_loss, eval_loss, ts): a run per user, purchases being evaluations."""
    return as_train_logs(table(spark, sf_dir, "events"))


def as_train_logs(events: DataFrame) -> DataFrame:
    is_eval = F.col("event_type") == "purchase"
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.when(~is_eval, F.col("value")).alias("train_loss"),
        F.when(is_eval, F.col("value")).alias("eval_loss"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with a blank line between lines and a blank block at the end."""
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n  \n")).alias("text")
    )
