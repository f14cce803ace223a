"""The corpus operators over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.llm import (
    chaining, fingerprints, lexical_search, mixing, near_dups, packing, personal_data, pu_quality, quality_rules, secret_ledger,
    token_cache, turn_repair, url_filter,
)
from loomset.llm.common import text_of


TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", *[_count(F.col("found"), k) for k in ("assign", "access", "hex")],
        F.sha2(secret_ledger.spelled(base), 256).alias("base_sha256"),
        secret_ledger.spelled(F.col("found")).alias("spans"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), ["page_id"], url_filter.rule_table(spark))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return judged.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op4_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(personal_data.KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(personal_data.KINDS)],
        F.sha2(personal_data.spelled(base), 256).alias("base_sha256"), personal_data.spelled(F.col("spans")).alias("spans"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.spelled(F.col("lanes")).alias("fingerprint"),
        fingerprints.spelled(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "host_rate")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ledger, op2_url_filter, op3_near_duplicates, op4_token_cache, op5_source_mixing,
        op6_personal_data, op7_repeated_passages, op8_fingerprints, op9_best_fit_packing, op10_host_quality,
        op11_lexical_search, op12_turn_repair, op13_pu_quality,
    )
}
