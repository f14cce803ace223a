"""BLEU, ROUGE and their report over (prediction, reference) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomset.functions.overlap import clipped_counts, match_counts
from loomset.functions.stem import stemmed_words
from loomset.functions.text import alnum_text, tokens
from loomset.runtime import spread

# BLEU orders with equal weights, the smoothing constant.
ORDERS = (1, 2, 3, 4)
SMOOTHING_K = 5.0

def ngram_overlap(df: DataFrame, key: str) -> DataFrame:
    """(key, n, pred_total, ref_total, clipped) for n = 1..4 over white-space tokens, by grouping n-grams."""
    rows = df.select(key, tokens("prediction").alias("_pt"), tokens("reference").alias("_rt"))
    sized = rows.withColumns({"_np": F.size("_pt"), "_nr": F.size("_rt")})
    counts = clipped_counts(sized, key, {f"c{n}": ("_pt", "_rt", n) for n in ORDERS}, "_np", "_nr")
    return counts.select(
        key,
        F.inline(F.array(*[
            F.struct(
                F.lit(n).alias("n"), _grams(F.col("_np"), n).alias("pred_total"),
                _grams(F.col("_nr"), n).alias("ref_total"), F.col(f"c{n}").alias("clipped"),
            ) for n in ORDERS
        ])),
    )


def _grams(size: Column, n: int) -> Column:
    return F.greatest(size - (n - 1), F.lit(0))


def bleu_score(clipped: list[Column], c: Column, r: Column) -> Column:
    """Sentence BLEU from clipped counts and lengths; NULL for an empty prediction.

    Orders without a match are smoothed by 1 / (2^i * K / ln c), i counting them
    (Chen and Cherry, 2014); without any common word the score is 0.
    """
    misses = F.lit(0)
    log_sum = F.lit(0.0)
    for n, matches in zip(ORDERS, clipped):
        total = F.greatest(c - (n - 1), F.lit(1))
        miss = (matches == 0) & (c > 1)
        misses = misses + F.when(miss, 1).otherwise(0)
        smoothed = F.log(c) / (F.pow(F.lit(2.0), misses) * SMOOTHING_K) / total
        p = F.when(miss, smoothed).otherwise(matches / total)
        log_sum = log_sum + F.when(p > 0, F.log(p) / len(ORDERS)).otherwise(0.0)
    brevity = F.when(c > r, 1.0).otherwise(F.exp(1 - r / c))
    return F.when(c > 0, F.when(clipped[0] == 0, 0.0).otherwise(brevity * F.exp(log_sum)))


def f_measure(common: Column, pred: Column, ref: Column) -> Column:
    """2PR / (P + R), 0 where nothing is shared."""
    return F.when(common > 0, 2.0 * common / (pred + ref)).otherwise(0.0)


def score_rows(df: DataFrame, key: str, bleu: bool = True, rouge_n: bool = True, rouge_l: bool = True,
               stem: bool = True, deal: bool = False) -> DataFrame:
    """(key, bleu, rouge1, rouge2, rougeL as asked), row by row without a shuffle.

    Tasks count matches; the scores are column expressions over the counts. Counting costs far more
    per byte than reading: with ``deal`` the rows go over all shuffle partitions first, for tables
    that come from few tasks, such as joins whose tasks hold what is little to read.
    """
    rows = df.select(key, "prediction", "reference")
    if deal:
        rows = spread(rows, key)
    if bleu:
        rows = rows.withColumn("_b", match_counts(F.col("prediction"), F.col("reference"), len(ORDERS)))
    if rouge_n or rouge_l:
        rows = rows.withColumn(
            "_r",
            match_counts(
                alnum_text("prediction"), alnum_text("reference"), 2 if rouge_n else 0,
                stemmed_words if stem else str.split, rouge_l,
            ),
        )
    b, r = (lambda f: F.col(f"_b.{f}")), (lambda f: F.col(f"_r.{f}"))
    out: list[Column] = [F.col(key)]
    if bleu:
        clipped = [F.get(b("clipped"), F.lit(n - 1)) for n in ORDERS]
        out.append(bleu_score(clipped, b("pred"), b("ref")).alias("bleu"))
    if rouge_n:
        for name, n in (("rouge1", 1), ("rouge2", 2)):
            common = F.get(r("clipped"), F.lit(n - 1))
            out.append(f_measure(common, _grams(r("pred"), n), _grams(r("ref"), n)).alias(name))
    if rouge_l:
        out.append(f_measure(r("lcs"), r("pred"), r("ref")).alias("rougeL"))
    return rows.select(*out)


def metric_report(scores: DataFrame) -> DataFrame:
    """(metric, value): means to 4 places; BLEU leaves out empty predictions, ROUGE does not."""
    # The names results are reported under.
    names = {"bleu": "BLEU-1", "rouge1": "ROUGE-1", "rouge2": "ROUGE-2", "rougeL": "ROUGE-L"}
    means = scores.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(m) for c, m in names.items()]
    )
    return means.unpivot([], list(names.values()), "metric", "value")


def evaluate(df: DataFrame, key: str, stem: bool = True) -> DataFrame | None:
    """The metric report, or None without references (automatic metrics are skipped)."""
    if "reference" not in df.columns:
        return None
    return metric_report(score_rows(df, key, stem=stem, deal=True))


def assemble_results(prompts: DataFrame, predictions: DataFrame, key: str, references: DataFrame | None = None,
                     judgments: DataFrame | None = None) -> DataFrame:
    """Rows that have a prediction, with reference and judgment columns if given."""
    extra = [t for t in (references, judgments) if t is not None]
    return reduce(lambda left, right: left.join(right, key, "left"), extra, prompts.join(predictions, key))
