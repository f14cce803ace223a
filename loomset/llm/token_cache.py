"""Token counts through a cache of content digests.

Counts are stored by the digest of the normalised text and of the tokenizer (its file, the
library's version and the settings). Only distinct texts that lack a count are encoded; their
counts are appended, and all rows read theirs from the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, functions as F

from loomset.llm.common import digest, hot_keys, salted_join, slices, stored, text_of
from loomset.llm.token_ids import encoder
from loomset.runtime import scratch_path

CACHE = "text_digest string, tokenizer string, n_tokens bigint"
_SETTINGS = "no added tokens, special strings as by default, no truncation, no padding"


def tokenizer_digest(path: str) -> str:
    """Changes with the tokenizer's file, the library or how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{tokenizers.__version__} {_SETTINGS}".encode()).hexdigest()


def encode_misses(texts: DataFrame, path: str, cache: str, version: str) -> None:
    """Append the counts of those (text_digest, text) rows that have none under ``version``.

    Copies are dropped inside each task before the shuffle. A job that dies appends nothing.
    """

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([len(ids) // 4 for some in slices(column) for ids in own.ids(some)], pa.int64())

    misses = texts.dropDuplicates(["text_digest"])
    known = stored(texts.sparkSession, cache, CACHE)
    if known is not None:
        misses = misses.join(known.where(F.col("tokenizer") == version), "text_digest", "left_anti")
    counted = misses.select("text_digest", F.lit(version).alias("tokenizer"), count("text").alias("n_tokens"))
    counted.write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, keys: list[str], path: str, cache: str | None = None, text: str = "text") -> DataFrame:
    """(keys, n_bytes, n_tokens) for every row of ``docs``, repeated rows included.

    ``path`` is a tokenizer file that driver and workers have; ``cache`` a shared folder that
    later calls pass again, or a fresh one. A NULL text is empty and has no tokens; keys may be
    NULL; an empty table gives an empty one; other columns are ignored. The text is taken
    exactly as it is: its only normalisation is that of NULL, as any other could change counts.
    """
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    version = tokenizer_digest(path)
    whole = text_of(text)
    encode_misses(docs.select(digest(whole).alias("text_digest"), whole.alias("text")), path, cache, version)
    counts = stored(docs.sparkSession, cache, CACHE).where(F.col("tokenizer") == version)
    counts = counts.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)],
        F.octet_length(whole).cast("bigint").alias("n_bytes"), digest(whole).alias("text_digest"),
    )
    joined = salted_join(rows, counts, "text_digest", "left", hot_keys(rows, "text_digest"))
    return joined.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], "n_bytes", "n_tokens")
