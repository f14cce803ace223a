"""Quality rules per document and per host.

Documents are measured by themselves; hosts are judged by how many of their documents fail,
with their rates shrunk towards those of all hosts by an empirical beta prior, and the verdict
on a host is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import hot_keys, salted_join, slices, small, text_of, unused
from loomset.runtime import materialise

# Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
#: The rate of failing documents that a host may have lies between these, where the prior of the other hosts puts it.
LEAST_LIMIT, MOST_LIMIT = 0.2, 0.5
#: Standard deviations above the mean of the other hosts' rates, to that limit.
DEVIATIONS = 3.0
#: Standard deviations of a host's own rate by which it must exceed the limit (99 per cent of its posterior).
SURENESS = 2.33
#: Weight of the prior, in documents, if hosts differ no more than chance makes them, or there is only one.
PRIOR_DOCUMENTS = 100.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    kinds = len(number)
    _, pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
    _, window, counts = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The ``MEASURES`` of a whole text."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
    return (
        len(words), len(text) - sum(map(text.count, _BLANKS)), sum(raw.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def _measure_all(texts: pa.Array) -> pa.Array:
    rows = [measure(t or "") for some in slices(texts) for t in some]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5, names=list(MEASURES))


def measured(text: Column) -> Column:
    """The ``MEASURES`` of a column of texts, as a struct."""
    return F.arrow_udf(_measure_all, f"struct<{','.join(f'{m}:bigint' for m in MEASURES)}>")(text)


def failed(m: Column) -> Column:
    """The base rules: too few words, or too many of them repeated."""
    return (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED_PERCENT)


def host_key(host: Column) -> Column:
    """A key that is never NULL; documents without a host share one."""
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n, n_failed, rate, rate_limit, host_kept) from (host, base_failed).

    The prior's mean is the rate of all documents; its weight follows from how much the rates
    of hosts vary beyond what chance gives (moments), so that a small host is judged mostly by
    the others and a large one by itself. A host's limit lies three deviations above the mean
    of the prior that all other hosts give, so that a bad one does not hide behind itself, and
    between a fifth and a half; the host goes if its rate exceeds that almost surely.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed"))
    hosts = materialise(hosts, "hosts")
    total, fails, k = hosts.agg(F.sum("n"), F.sum("n_failed"), F.count("*")).first()
    mean = (fails or 0) / (total or 1)
    spread, squares = hosts.agg(
        F.sum(F.col("n") * F.pow(F.col("n_failed") / F.col("n") - F.lit(mean), 2)), F.sum(F.col("n").cast("double") * F.col("n"))
    ).first()
    weight = PRIOR_DOCUMENTS
    if k > 1 and 0 < mean < 1:
        # Var of a host's rate: m(1-m)/n * (1 + (n-1)/(weight+1)); solve the weighted sum for the correlation 1/(weight+1).
        chance = mean * (1 - mean)
        common = (spread - (k - 1) * chance) / (chance * max(total - squares / total - (k - 1), 1e-9))
        weight = 1 / common - 1 if 0 < common < 1 else PRIOR_DOCUMENTS if common <= 0 else 0.0
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    # The sums without the host's own part give the prior of the others; it is never surer than the weakest one.
    ratio = hosts.agg(F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n"))).first()[0]
    n, bad = F.col("n").cast("double"), F.col("n_failed").cast("double")
    others, other_fails, other_hosts = F.lit(float(total or 0)) - n, F.lit(float(fails or 0)) - bad, k - 1
    own = other_fails / F.nullif(others, F.lit(0.0))  # NULL for an only host
    chance = own * (1 - own)
    apart = F.lit(ratio or 0.0) - bad * bad / n - other_fails * own - F.lit(float(other_hosts - 1)) * chance
    room = F.greatest(others - (F.lit(squares or 0.0) - n * n) / F.nullif(others, F.lit(0.0)) - F.lit(float(other_hosts - 1)), F.lit(1e-9))
    common = F.least(F.lit(1.0), F.greatest(F.lit(1 / (PRIOR_DOCUMENTS + 1)), apart / F.nullif(chance * room, F.lit(0.0))))
    limit = F.greatest(F.lit(LEAST_LIMIT), F.least(F.lit(MOST_LIMIT), own + DEVIATIONS * F.sqrt(chance * common)))
    limit = F.when(others <= 0, MOST_LIMIT).when(chance <= 0, F.when(own > 0, MOST_LIMIT).otherwise(LEAST_LIMIT)).otherwise(limit)
    # Wilson's lower bound, which a handful of documents cannot bring above the limit.
    p, seen = F.col("rate"), n + F.lit(weight)
    least = (p + SURENESS**2 / 2 / seen - SURENESS * F.sqrt(p * (1 - p) / seen + (SURENESS / 2 / seen) ** 2)) / (1 + SURENESS**2 / seen)
    judged = hosts.withColumn("rate", rate).withColumn("rate_limit", limit)
    return judged.withColumn("host_kept", least <= F.col("rate_limit"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, measures, base_failed, host_rate, host_limit, kept), one row per row of ``docs``.

    ``kept`` is false if the base rules fail or the host's shrunken rate is surely above its limit. A NULL
    text has no words and fails; documents without a host are a host of their own; numbers may
    be NULL or repeat; an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), host_key(F.col(host)).alias("host"), measured(text_of(text)).alias("m"))
    rows = materialise(rows.select("doc_id", "host", "m.*", failed(F.col("m")).alias("base_failed")), "measures")
    verdicts = host_verdicts(rows).select("host", "rate", "rate_limit", "host_kept")
    joined = salted_join(rows, verdicts, "host", "left", hot_keys(rows, "host"))
    return joined.select(
        "doc_id", F.when(F.col("host") != "-", F.substring("host", 2, 1 << 30)).alias("host"), *MEASURES, "base_failed",
        F.col("rate").alias("host_rate"), F.col("rate_limit").alias("host_limit"), (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.

    Only rejected hosts are joined back, broadcast if they are few and their names short.
    """
    m, key = unused(docs, "measures"), unused(docs, "host_key")
    passed = docs.withColumn(m, measured(text_of(text))).withColumn(key, host_key(F.col(host)))
    light = materialise(passed.select(F.col(key).alias("host"), failed(F.col(m)).alias("base_failed")), "failures")
    rejected = host_verdicts(light).where(~F.col("host_kept")).select(F.col("host").alias(key))
    passed = passed.where(~failed(F.col(m))).drop(m)
    if small(rejected, F.octet_length(key)):
        return passed.join(F.broadcast(rejected), key, "left_anti").select(*docs.columns)
    return salted_join(passed, rejected, key, "left_anti", hot_keys(passed, key)).select(*docs.columns)
