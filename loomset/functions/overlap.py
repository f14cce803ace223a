"""Sequence overlap: clipped n-gram counts and longest common subsequence."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomset.runtime import spread


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as blank-joined strings; empty when there are fewer than n tokens."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def clipped_counts(df: DataFrame, key: str, features: dict[str, tuple[str, str, int]], *keep: str) -> DataFrame:
    """(key, keep..., one count per feature): n-grams both sides share, each side's repeats respected.

    ``features`` maps a name to (prediction tokens, reference tokens, n). Rows are
    hashed by ``key`` before they unfold, so both groupings find theirs in place: the
    tokens shuffle once and the n-grams, many times as large, never do.
    """
    def side(name: str, column: str, is_pred: bool, n: int) -> Column:
        return F.transform(
            ngrams(F.col(column), n),
            lambda g: F.struct(F.lit(name).alias("f"), F.lit(is_pred).alias("p"), g.alias("g")),
        )

    sides = [
        one
        for name, (pred, ref, n) in features.items()
        for one in (side(name, pred, True, n), side(name, ref, False, n))
    ]
    grams = spread(df, key).select(key, *keep, F.explode_outer(F.concat(*sides)).alias("x"))
    common = grams.groupBy(key, *keep, "x.f", "x.g").agg(
        F.least(F.count_if("x.p"), F.count_if(~F.col("x.p"))).alias("c")
    )
    return common.groupBy(key, *keep).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("f") == name, F.col("c"))), F.lit(0)).cast("long").alias(name)
            for name in features
        ]
    )


#: A word operation covers so many bits; a match costs about so many of them.
_WORD_BITS, _MATCH_COST = 64, 64
_FEW_BITS = 4096  # shorter texts always go by bits


def lcs_length(a, b) -> int:
    """Longest common subsequence length, by bits or, where elements rarely match, by matches."""
    if len(a) > _FEW_BITS:
        count = Counter(a)
        matches = sum(count[t] for t in b)
        if matches * _MATCH_COST < len(a) * len(b) // _WORD_BITS:
            return lcs_by_matches(a, b)
    return lcs_by_bits(a, b)


def lcs_by_matches(a, b) -> int:
    """The same from the positions that match alone (Hunt and Szymanski, 1977).

    ``ends[k]`` is the least position of ``a`` at which a common subsequence of k + 1 elements ends;
    the positions of one element are taken from the last, so that each is used once.
    """
    where: dict[str, list[int]] = {}
    for i in range(len(a) - 1, -1, -1):
        where.setdefault(a[i], []).append(i)
    ends: list[int] = []
    for t in b:
        for i in where.get(t, ()):
            k = bisect_left(ends, i)
            if k == len(ends):
                ends.append(i)
            else:
                ends[k] = i
    return len(ends)


def lcs_by_bits(a, b) -> int:
    """The same with a bit per element of ``a`` (Hyyro, 2004)."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def shared_ngrams(a: list[str], b: list[str], n: int) -> int:
    """N-grams both sequences have, each counted as often as in the side with fewer."""
    x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
    return sum(min(c, y[g]) for g, c in x.items() if g in y)


def match_counts(pred: Column, ref: Column, orders: int, words: Callable[[str], list[str]] = str.split,
                 with_lcs: bool = False) -> Column:
    """struct(clipped per n-gram order, prediction size, reference size, lcs) of two texts.

    Counts leave the row's own task only as these few numbers: no n-gram is shuffled or
    kept beyond its row. NULL reads as empty.
    """

    def one(a: str | None, b: str | None) -> tuple[list[int], int, int, int]:
        p, r = words(a or ""), words(b or "")
        clipped = [shared_ngrams(p, r, n) for n in range(1, orders + 1)]
        return clipped, len(p), len(r), lcs_length(p, r) if with_lcs else 0

    def count(preds: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = [one(a, b) for a, b in zip(preds, refs)]
        return pd.DataFrame(rows, columns=["clipped", "pred", "ref", "lcs"])

    return F.pandas_udf(count, "clipped array<int>, pred int, ref int, lcs int")(pred, ref)
