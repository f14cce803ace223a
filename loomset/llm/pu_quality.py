"""Quality scores learned from trusted positives and unlabelled web text.

A logistic model over measures of the characters and words of a text is fitted by the non-negative
unbiased risk of positive-unlabelled learning: no negative label is used. The share of good texts
among the unlabelled ones, which that risk needs, is estimated first, by the best bin of a
classifier that tells the two samples apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import slices, small, text_of
from loomset.runtime import materialise

FOLDS, HELD_OUT = 5, 0  # rows whose digest modulo FOLDS is HELD_OUT lend no label
THRESHOLD = 0.3
#: Most rows, but for chance, that the fit takes of either kind; drawn by a hash of their numbers.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
TOLERANCE = 0.1  # chance of error in the bound that picks the bin

# Character classes of UTF-8 bytes: lower, upper, digit, space, line break, full stops, commas, quotes, brackets, dashes,
# slashes, symbols, bars, exclamations, beyond ASCII, controls.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".:", ",;", "'\"`", "()[]{}", "-_~", "/\\@", "#*$%&+=^<>", "|", "!?")
_BEYOND, _CONTROL = len(_CLASSES), len(_CLASSES) + 1
KINDS = len(_CLASSES) + 2
_CLASS_OF = bytes(
    next((i for i, c in enumerate(_CLASSES) if chr(b) in c), _BEYOND if b >= 128 else _CONTROL) for b in range(256)
)
MEASURES = 12
WIDTH = KINDS * KINDS + MEASURES


def features(text: str) -> np.ndarray:
    """Shares of pairs of neighbouring character classes (square roots), then measures of words and lines."""
    raw = text.encode()
    kinds = np.frombuffer(raw.translate(_CLASS_OF), np.uint8)
    pairs = np.bincount(kinds[:-1].astype(np.int64) * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(kinds) > 1 else np.zeros(KINDS * KINDS)
    words = raw.lower().split()
    counts = Counter(words)
    n, distinct = len(words), len(counts)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    often = np.sort(np.fromiter(counts.values(), np.float64, distinct))[::-1]
    shares = often / max(n, 1)
    return np.concatenate([
        np.sqrt(pairs / max(len(kinds) - 1, 1)),
        [
            np.log1p(len(raw)), np.log1p(n), len(raw) / (n + 1), distinct / (n + 1), np.log1p(distinct) / (np.log1p(n) + 1),
            again / max(n - 1, 1), shares[0] if n else 0.0, shares[:10].sum(), -(shares * np.log(shares + 1e-12)).sum(),
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), n / (len(lines) + 1),
        ],
    ]).astype(np.float32)


@dataclass
class Model:
    """``score`` of a feature row is the logistic of its standardised weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _logistic(np.clip((rows - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias)


CLIP = 8.0  # standard deviations beyond which a measure counts no further


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(gradient, width: int, steps: int) -> np.ndarray:
    """Adam on the weights and the bias (last); ``gradient(w)`` is that of the risk."""
    w, first, second = (np.zeros(width + 1) for _ in range(3))
    for step in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += RIDGE * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> float:
    """The share of positives among the unlabelled (standardised rows), at most 1.

    One half of each sample trains a classifier of positive against unlabelled; on the other half
    the ratio of the shares above a score, least where nearly only positives lie, is the prior; the
    score is the one at which the ratio plus its margin of chance is least.
    """
    halves = lambda x: (x[::2], x[1::2])
    (p, p_other), (u, u_other) = halves(positive), halves(unlabelled)
    if not len(p_other) or not len(u_other):
        return 0.5
    x = np.concatenate([p, u])
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y > 0, 0.5 / len(p), 0.5 / len(u))

    def gradient(w: np.ndarray) -> np.ndarray:
        error = weight * (_logistic(x @ w[:-1] + w[-1]) - y)
        return np.append(error @ x, error.sum())

    w = _descend(gradient, x.shape[1], steps)
    score_p, score_u = np.sort(p_other @ w[:-1]), np.sort(u_other @ w[:-1])
    above = lambda scores, at: 1 - np.searchsorted(scores, at, side="left") / len(scores)
    share_p, share_u = above(score_p, score_p), above(score_u, score_p)
    margin = np.sqrt(np.log(4 / TOLERANCE) / 2) * (len(score_p) ** -0.5 + len(score_u) ** -0.5)
    best = np.argmin((share_u + margin) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS) -> Model | None:
    """The model of least non-negative unbiased risk under the logistic loss; None without either sample.

    The risk of negatives is that of the unlabelled less the positives' share of it. While it is
    below zero, which no risk can be, steps go up that term instead (Kiryo et al., 2017).
    """
    if not len(positive) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-4
    p, u = (np.clip((x.astype(np.float64) - mean) / scale, -CLIP, CLIP) for x in (positive, unlabelled))
    if prior is None:
        prior = estimate_prior(p, u, steps)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        good_p, good_u = _logistic(zp), _logistic(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_p, of_u = -prior * good_p / len(p), good_u / len(u)
        if negative < 0:
            of_p, of_u = -of_p, -of_u
        else:
            of_p = of_p + prior * (good_p - 1) / len(p)
        return np.append(of_p @ p + of_u @ u, of_p.sum() + of_u.sum())

    w = _descend(gradient, p.shape[1], steps)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]), prior)


def bucket(doc_id: Column) -> Column:
    """The digest of a number modulo ``FOLDS``; a NULL reads as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _unit(key: Column) -> Column:
    """A hash of the number, even in [0, 1)."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / (1 << 30)


def training_numbers(docs: DataFrame, labels: DataFrame, doc_id: str, quality: str, most_positive: int, most_unlabelled: int) -> DataFrame:
    """(doc_id, trusted): documents to learn from, none held out; about the given numbers of either kind.

    A document is trusted if all its labels are 1 and unlabelled if it has none; where no document
    is unlabelled, all of them stand for the web.
    """
    judged = labels.where(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(quality) > 0).alias("trusted"))
    numbers = docs.select(F.col(doc_id).alias("doc_id")).where(F.col(doc_id).isNotNull() & (bucket(F.col(doc_id)) != HELD_OUT)).distinct()
    numbers = materialise(numbers.join(judged, "doc_id", "left"), "numbers")
    n_positive, n_unlabelled, n = numbers.agg(F.count(F.when(F.col("trusted"), 1)), F.count(F.when(F.col("trusted").isNull(), 1)), F.count("*")).first()
    unlabelled = F.col("trusted").isNull() if n_unlabelled else F.lit(True)
    drawn = lambda rows, total, most: rows.where(_unit(F.col("doc_id")) * total < most).select("doc_id")
    return drawn(numbers.where("trusted"), n_positive, most_positive).withColumn("trusted", F.lit(True)).unionByName(
        drawn(numbers.where(unlabelled), n_unlabelled or n, most_unlabelled).withColumn("trusted", F.lit(False))
    )


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tobytes() for some in slices(batch.column("text")) for t in some]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trusted"), pa.array(rows, pa.binary())], names=["doc_id", "trusted", "features"])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """The model of the documents' trusted positives and unlabelled texts; None if either is lacking.

    It is fitted on the driver on a sample whose size the two numbers bound. A document whose number
    is NULL, or repeats under one label, is learned from never, or once for each of its texts.
    """
    wanted = materialise(training_numbers(docs, labels, doc_id, quality, most_positive, most_unlabelled), "training")
    wanted = F.broadcast(wanted) if small(wanted, F.lit(16)) else wanted
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(wanted, "doc_id")
    kind = docs.schema[doc_id].dataType.simpleString()
    drawn = materialise(rows.mapInArrow(_feature_rows, f"doc_id {kind}, trusted boolean, features binary"), "features")
    # Repeated numbers could make the sample larger than drawn, so that the bound is kept once more.
    got = drawn.orderBy("doc_id", "trusted", "features").limit(2 * (most_positive + most_unlabelled)).collect()
    matrix = lambda wanted: np.array([np.frombuffer(r["features"], np.float32) for r in got if r["trusted"] == wanted]).reshape(-1, WIDTH)
    return fit(matrix(True), matrix(False))


def scored(text: Column, model: Model | None) -> Column:
    """The score of a column of texts, 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(np.stack([features(t) for t in some])) for some in slices(texts)]
        return pa.array(np.concatenate(parts).astype(np.float64) if parts else [], pa.float64())

    return F.arrow_udf(score, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
             threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows included.

    The score depends on the text alone. NULL and empty texts are scored like others, by the same
    measures; a NULL number is held out; labels that are NULL, contradict each other or name no
    document teach nothing; without trusted positives, or without any document, all scores are 0.5;
    an empty table gives an empty one; other columns are ignored.
    """
    model = learn(docs, labels, doc_id, text, quality, **bounds)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (bucket(F.col(doc_id)) == HELD_OUT).alias("held_out"), scored(text_of(text), model).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
