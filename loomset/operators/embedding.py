"""Greedy cosine matching of two sets of token vectors per pair (precision, recall, F1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256  # vectors per block: two blocks and their cosines stay small in a task
CHUNK = 16  # blocks per chunk: a task matches one chunk of either side at a time
_SALTS = 16


def embedding_match(vectors: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(pair_id, side, pos, vec) -> (pair_id, p, r, f1).

    p is the mean over ``pred`` vectors of the best cosine with a ``ref`` vector, r the
    converse. Vectors meet block by block, as two matrices, and only each vector's best
    cosine per block leaves the task. Blocks are hashed by pair and by the chunks of both
    sides, so the work on a very large pair spreads and no task holds a whole side.
    ``pos`` numbers the vectors of a side from 0.
    """
    blk = F.floor(F.col("pos") / block)
    last = vectors.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == "pred", F.floor(blk / chunk))).alias("pred_last"),
        F.max(F.when(F.col("side") == "ref", F.floor(blk / chunk))).alias("ref_last"),
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))

    def blocks(side: str, other: str) -> DataFrame:
        """One row per block of ``side`` and chunk of the ``other`` side."""
        rows = vectors.where(F.col("side") == side).groupBy("pair_id", blk.alias("blk")).agg(
            F.collect_list(F.struct("pos", "vec")).alias(side)
        )
        salted = rows.withColumn("_salt", F.pmod("blk", F.lit(_SALTS)).cast("int")).join(last, ["pair_id", "_salt"])
        return salted.select(
            "pair_id", F.floor(F.col("blk") / chunk).alias(f"{side}_chunk"),
            F.explode(F.sequence(F.lit(0).cast("long"), f"{other}_last")).alias(f"{other}_chunk"), side,
        )

    pred, ref = blocks("pred", "ref"), blocks("ref", "pred")
    met = pred.join(ref, ["pair_id", "pred_chunk", "ref_chunk"]).select(
        "pair_id",
        best_cosines(F.col("pred.vec"), F.col("ref.vec")).alias("best"),
        F.col("pred.pos").alias("pred_pos"),
        F.col("ref.pos").alias("ref_pos"),
    )
    return match_scores(met.select("pair_id", sides_apart()), vectors)


def sides_apart() -> Column:
    """(side, pos, cos) rows of columns best, pred_pos and ref_pos."""
    return F.inline(
        F.concat(
            F.zip_with("pred_pos", "best.pred", lambda i, c: F.struct(F.lit("pred").alias("side"), i.alias("pos"), c.alias("cos"))),
            F.zip_with("ref_pos", "best.ref", lambda i, c: F.struct(F.lit("ref").alias("side"), i.alias("pos"), c.alias("cos"))),
        )
    )


def match_scores(sided: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, p, r, f1) for every pair of ``vectors``, from cosines (pair_id, side, pos, cos) that have each vector's best."""
    best = sided.groupBy("pair_id", "side", "pos").agg(F.max("cos").alias("cos"))
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("cos")))
    p, r = F.col("p"), F.col("r")
    means = best.groupBy("pair_id").agg(mean("pred").alias("p"), mean("ref").alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # A pair with vectors on one side only has no match and scores 0.
    scored = vectors.select("pair_id").distinct().join(means, "pair_id", "left")
    return scored.select("pair_id", zero("p").alias("p"), zero("r").alias("r")).withColumn(
        "f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    )


def _best(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows, columns = [], []
    for a, b in zip(pred, ref):
        x, y = (np.stack(m).astype("float64") for m in (a, b))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        cos = x @ y.T
        rows.append(cos.max(axis=1))
        columns.append(cos.max(axis=0))
    return pd.DataFrame({"pred": rows, "ref": columns})


def best_cosines(pred, ref):
    """Two blocks of vectors -> each vector's best cosine with the other block."""
    return F.pandas_udf(_best, "pred array<double>, ref array<double>")(pred, ref)


def token_vectors(df: DataFrame, key: str, load: Callable[[], Any], embed: Callable[[Any, str], list[list[float]]]) -> DataFrame:
    """(pair_id, side, pos, vec) from (key, prediction, reference) by the caller's model, loaded on the workers.

    ``embed(model, text)`` gives the vectors of a text's tokens in order; NULL and empty texts have none.
    """
    schema = f"pair_id {df.schema[key].dataType.simpleString()}, side string, pos int, vec array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for pair, pred, ref in zip(frame[key], frame["prediction"], frame["reference"]):
                found = [
                    (pair, side, pos, list(map(float, vec)))
                    for side, text in (("pred", pred), ("ref", ref)) if text
                    for pos, vec in enumerate(embed(model, text))
                ]
                if found:
                    yield pd.DataFrame(found, columns=["pair_id", "side", "pos", "vec"])

    return df.select(key, "prediction", "reference").mapInPandas(run, schema)


def complete_matches(matches: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``matches`` for all ``pairs``: 0 for a pair without any vector."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    every = pairs.select(F.col(key).alias("pair_id")).join(matches, "pair_id", "left")
    return every.select("pair_id", *[zero(c) for c in ("p", "r", "f1")])


def match_report(matches: DataFrame) -> DataFrame:
    """(metric, value): means to 4 places, 0 without any pair."""
    # The names results are reported under.
    names = {"p": "BERTScore-P", "r": "BERTScore-R", "f1": "BERTScore-F1"}
    means = matches.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(m) for c, m in names.items()]
    )
    return means.unpivot([], list(names.values()), "metric", "value")
