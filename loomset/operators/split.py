"""Exact, reproducible train/test split without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from loomset.runtime import materialise

SEED = 42
TEST_FRACTION = 0.1
HASH_DIGITS = 32
_DIGITS = 5  # hash digits per round: at most 16 ** 5 counts
_RANKED = 100_000  # most rows that one task ranks


def split_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), _spelled(key)))


def _spelled(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\0"))


def with_split(
    df: DataFrame, key: str, test_fraction: float = TEST_FRACTION, seed: int = SEED
) -> DataFrame:
    """Add ``split``: the ``ceil(test_fraction * n)`` rows of least hash are ``test``, the rest ``train``.

    ``key`` must be unique; one row without a key counts as a key. Rows of equal keys stay
    together, so that repeated keys move the size by their number. Hashes are written once; ``df`` is
    evaluated for them and for the result, and its rows never shuffle (:func:`_at_rank`).
    """
    hashed = materialise(df.select(split_hash(F.col(key), seed).alias("h"), _spelled(F.col(key)).alias("k")), "hashes")
    cut = _at_rank(hashed, test_fraction)
    h = split_hash(F.col(key), seed)
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    in_test = (h < F.lit(cut["h"])) | ((h == F.lit(cut["h"])) & (_spelled(F.col(key)) <= F.lit(cut["k"])))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def _at_rank(hashed: DataFrame, fraction: float, digits: int = _DIGITS, most: int = _RANKED) -> Row | None:
    """The row (h, k) of rank ``ceil(fraction * n)`` by hash, or None for rank 0.

    Rounds of radix selection: rows are counted by the next ``digits`` of their hashes (combined
    map-side, at most 16**digits counts), and the prefix that holds the rank is the next round's
    table, until it has at most ``most`` rows or a hash has no further digit; only these are ranked,
    by key too. Each round reads the written hashes, not the rows.
    """
    prefix, rest, left = "", None, hashed
    while True:
        place = len(prefix)
        counts = left.groupBy(F.substring("h", place + 1, digits).alias("b")).agg(F.count("*").alias("n"))
        running = counts.select("b", "n", F.sum("n").over(Window.orderBy("b")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
        wanted = F.ceil(F.lit(float(fraction)) * F.col("total")) if rest is None else F.lit(rest)
        edge = running.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(
            "b", "n", (wanted - F.col("upto") + F.col("n")).alias("rest")
        ).first()
        if edge is None:
            return None
        prefix, rest = prefix + edge["b"], edge["rest"]
        left = hashed.where(F.startswith("h", F.lit(prefix)))
        if edge["n"] <= most or place + digits >= HASH_DIGITS:
            break
    # Equal hashes are of equal keys, so that a hash that many rows have needs one of them alone.
    if place + digits >= HASH_DIGITS:
        left = left.groupBy("h", "k").agg(F.count("*").alias("n"))
    else:
        left = left.withColumn("n", F.lit(1))
    ranked = left.select("h", "k", F.sum("n").over(Window.orderBy("h", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    return ranked.where(F.col("upto") >= rest).orderBy("h", "k").select("h", "k").first()


def train_test_split(
    df: DataFrame, key: str, test_fraction: float = TEST_FRACTION, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    labelled = with_split(df, key, test_fraction, seed)
    return tuple(labelled.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def split_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("split").agg(F.count("*").alias("n"))
