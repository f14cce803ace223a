"""URL filters by hash prefix.

Rules and URLs meet as expressions, a host suffix followed by a path prefix: a URL is expanded
into those of its expressions whose label count and path length some rule has, these are
equi-joined with the rules on a short hash prefix, a full digest confirms each meeting, and the
longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.llm.common import hot_keys, salted_join, small

PREFIX = 8  # hexadecimal digits of the joined prefix
# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"  # for a URL that no rule fits


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(host).cast("string"), F.lit(" "), host, path), 256)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for each of the distinct ``urls`` (url, host, path) that some rule fits.

    The shapes of all rules (label counts, path lengths) are two short lists of numbers; a URL
    yields at most one expression per pair of them, however long it is.
    """
    rules = rules.select("verdict", "host", "path").where("host is not null and path is not null").distinct()
    shapes = rules.agg(
        F.collect_set(_labels(F.col("host"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    parts = F.split("host", r"\.", -1)
    hosts = F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(shapes["labels"])
    ] or [F.lit(None).cast("string")])
    paths = F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes["lengths"])
    ] or [F.lit(None).cast("string")])
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _expression(h, p))))
    expanded = urls.select("url", F.explode(F.filter(pairs, lambda e: e.isNotNull())).alias("digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX))
    listed = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        _expression(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))
    if small(listed, F.octet_length("rule") + 128):
        met = expanded.join(F.broadcast(listed), "prefix")
    else:
        grouped = listed.groupBy("prefix").agg(F.collect_list(F.struct("verdict", "rule", "host_length", "rule_digest")).alias("listed"))
        met = salted_join(expanded, grouped, "prefix", "inner", hot_keys(expanded, "prefix")).select(
            "url", "digest", F.explode("listed").alias("r")
        ).select("url", "digest", "r.*")
    fits = met.where(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.length("rule"), F.col("host_length"), F.col("verdict"), F.col("rule"))
    best = fits.groupBy("url").agg(F.max(order.alias("best")).alias("best"))
    return best.select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, keys: list[str], rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(keys, host, path, rule, verdict) for every row of ``pages``, repeated rows included.

    The longest rule (host and path together, then host) wins, and of equal rules ``block``. A
    URL that no rule fits, a NULL or one without ``://`` has a NULL rule and the ``default``
    verdict. Rules with a NULL host or path are left out. Keys may be NULL; other columns of
    ``pages`` are ignored. Distinct URLs are judged once, and only those that a rule fits are
    joined back, salted where one URL has many rows.
    """
    rows = pages.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.coalesce(F.col(url), F.lit("")).alias("url"))
    distinct = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    joined = salted_join(rows, match_rules(distinct, rules), "url", "left", hot_keys(rows, "url"))
    return joined.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
