"""The embedding match without all pairs: balls of vectors that are too far apart never meet.

Vectors of a side are put into balls around pivots, which are vectors of that side. On the unit
sphere the triangle inequality bounds the angles between two balls by their centres and radii, so
that most blocks are passed over where vectors lie in clusters, and the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomset.operators.embedding import BLOCK, best_cosines, match_scores, sides_apart
from loomset.runtime import materialise

SLACK = 1e-6  # radians: more than rounding moves an angle
_SALTS = 16
_NEAR = "array<struct<pos:bigint,vec:array<double>,angle:double,pivot:bigint,centre:array<double>>>"


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype("float64")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _angles(x, y) -> np.ndarray:
    """Angles of all vectors of ``x`` with all of ``y``; a zero vector is at a right angle to any."""
    return np.arccos(np.clip(_unit(x) @ _unit(y).T, -1, 1))


def _nearest(pos: pd.Series, vec: pd.Series, pivot: pd.Series, centre: pd.Series) -> pd.Series:
    out = []
    for p, v, ids, c in zip(pos, vec, pivot, centre):
        angles = _angles(v, c)
        near = angles.argmin(axis=1)
        out.append([
            {"pos": int(i), "vec": w, "angle": float(angles[k, j]), "pivot": int(ids[j]), "centre": c[j]}
            for k, (i, w, j) in enumerate(zip(p, v, near))
        ])
    return pd.Series(out)


def balls(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, side, ball, n, radius, centre, pos, vec): about ``block`` vectors a row, the last two as arrays.

    About one vector in ``block`` is a pivot, drawn by a hash of its position, and the first of each
    side always is. Vectors meet pivots as matrices. A crowded ball is cut into several of the same centre.
    """
    place = ["pair_id", "side"]
    rows = vectors.select(*place, F.col("pos").cast("bigint").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    first = rows.groupBy(*place).agg(F.min("pos").alias("pos"), F.first(F.lit(True)).alias("first"))
    drawn = F.pmod(F.xxhash64("pair_id", "side", "pos"), F.lit(block)) == 0
    heads = rows.join(first, [*place, "pos"]).drop("first").unionByName(
        rows.where(drawn).join(first, [*place, "pos"], "left_anti")
    )
    # Pivots of a side in groups of about ``block``, one copy for each salt of its vectors.
    grouped = heads.groupBy(*place, F.floor(F.col("pos") / (block * block)).alias("g")).agg(F.collect_list(F.struct("pos", "vec")).alias("c"))
    pivots = grouped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    blocks = rows.groupBy(*place, F.floor(F.col("pos") / block).alias("blk")).agg(F.collect_list(F.struct("pos", "vec")).alias("v"))
    blocks = blocks.withColumn("_salt", F.pmod("blk", F.lit(_SALTS)).cast("int"))
    near = blocks.join(pivots, [*place, "_salt"]).select(
        *place, F.inline(F.pandas_udf(_nearest, _NEAR)(F.col("v.pos"), F.col("v.vec"), F.col("c.pos"), F.col("c.vec")))
    )
    best = near.groupBy(*place, "pos").agg(F.min(F.struct("angle", "pivot", "centre", "vec")).alias("b")).select(*place, "pos", "b.*")
    best = materialise(best, "nearest_pivots")
    # Vectors of a crowded pivot find its size on one of 16 copies.
    sizes = best.groupBy(*place, "pivot").agg(F.ceil(F.count("*") / block).alias("parts"))
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = best.withColumn("_salt", F.pmod("pos", F.lit(_SALTS)).cast("int")).join(sizes, [*place, "pivot", "_salt"])
    part = F.pmod(F.xxhash64("pos"), F.col("parts"))
    return materialise(
        own.groupBy(*place, "pivot", part.alias("part")).agg(
            F.count("*").alias("n"), F.max("angle").alias("radius"), F.first("centre").alias("centre"),
            F.collect_list(F.struct("pos", "vec")).alias("held"),
        ).select(
            *place, F.concat_ws(":", "pivot", "part").alias("ball"), "n", "radius", "centre",
            F.col("held.pos").alias("pos"), F.col("held.vec").alias("vec"),
        ),
        "balls",
    )


def _closest(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    found = [_angles([b["centre"] for b in p], [b["centre"] for b in r]) for p, r in zip(pred, ref)]
    return pd.DataFrame({"pred": [a.min(axis=1) for a in found], "ref": [a.min(axis=0) for a in found]})


def _within(pred: pd.Series, ref: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(pred, ref):
        column = lambda side, name: np.array([b[name] for b in side])
        nearest = _angles([b["centre"] for b in p], [b["centre"] for b in r]) - column(p, "radius")[:, None] - column(r, "radius")
        reach = np.maximum(column(p, "reach")[:, None], column(r, "reach"))
        out.append([{"pred_ball": p[i]["ball"], "ref_ball": r[j]["ball"]} for i, j in np.argwhere(nearest <= reach + SLACK)])
    return pd.Series(out)


def meetings(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, pred_ball, ref_ball): the balls that may hold the best partner of a vector of either.

    A centre is a vector of its side, so each vector of a ball has a partner within the ball's ``reach``,
    the angle to the other side's closest centre and its own radius; balls further apart are passed over.
    """
    light = found.select("pair_id", "side", "ball", "radius", "centre").withColumn("g", F.pmod(F.xxhash64("ball"), F.lit(1 << 30)))
    groups = light.groupBy("pair_id", "side").agg(F.ceil(F.count("*") / block).alias("groups"))
    light = light.join(groups, ["pair_id", "side"]).withColumn("g", F.col("g") % F.col("groups")).drop("groups")

    def met(rows: DataFrame, *fields: str) -> DataFrame:
        packed = lambda side: rows.where(F.col("side") == side).groupBy("pair_id", F.col("g").alias(f"{side}_g")).agg(
            F.collect_list(F.struct("ball", "radius", "centre", *fields)).alias(side)
        )
        pred = packed("pred").withColumn("_salt", F.pmod("pred_g", F.lit(_SALTS)).cast("int"))
        ref = packed("ref").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        return pred.join(ref, ["pair_id", "_salt"])

    closest = met(light).withColumn("best", F.pandas_udf(_closest, "pred array<double>, ref array<double>")("pred", "ref"))
    angles = [
        closest.select("pair_id", F.lit(side).alias("side"), F.inline(F.arrays_zip(F.col(f"{side}.ball").alias("ball"), F.col(f"best.{side}").alias("angle"))))
        for side in ("pred", "ref")
    ]
    reach = angles[0].unionByName(angles[1]).toDF("pair_id", "side", "ball", "angle").groupBy("pair_id", "side", "ball").agg(F.min("angle").alias("angle"))
    reached = light.join(reach, ["pair_id", "side", "ball"]).withColumn("reach", F.col("angle") + F.col("radius"))
    within = F.pandas_udf(_within, "array<struct<pred_ball:string,ref_ball:string>>")
    return met(reached, "reach").select("pair_id", F.inline(within("pred", "ref")))


def embedding_match_pruned(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, side, pos, vec) -> (pair_id, p, r, f1), as ``embedding_match`` gives them.

    For large pairs whose vectors lie in clusters; without clusters all balls meet, and the plain match is
    cheaper. ``pos`` is a vector's own number within its side; zero vectors have cosine 0 with all.
    """
    found = balls(vectors, block)
    side = lambda s: found.where(F.col("side") == s).select(
        "pair_id", F.col("ball").alias(f"{s}_ball"), F.col("pos").alias(f"{s}_pos"), F.col("vec").alias(f"{s}_vec")
    )
    met = meetings(found, block).join(side("pred"), ["pair_id", "pred_ball"]).join(side("ref"), ["pair_id", "ref_ball"])
    sided = met.select("pair_id", best_cosines(F.col("pred_vec"), F.col("ref_vec")).alias("best"), "pred_pos", "ref_pos")
    return match_scores(sided.select("pair_id", sides_apart()), vectors)
