"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of a file is content-addressed; the ledger holds, per blob, what each version of
each rule has found. A scan reads only blobs that lack a rule version, once however many paths
and versions share them, and the findings are then joined back to all of these.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import digest, hot_keys, salted_join, stored, text_of
from loomset.runtime import scratch_path


class Rule(NamedTuple):
    """Matches of ``pattern`` are kept if capture ``group`` has ``least`` characters. Names rank as listed."""

    name: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules, then those of well-known credential formats. The two run-shaped
# rules ask for the least length at once: a shorter run has no part that could match.
RULES = (
    Rule("assign", 1, r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
         r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)

_SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, results array<struct<rule:string,spans:{_SPANS}>>"


def spans(text: Column, rule: Rule) -> Column:
    """The [start, end) of the kept matches, in code points.

    The pieces between the matches and the matches themselves alternate, so that running
    sums of their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )
    nothing = F.array().cast(_SPANS)

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + part["gap"]
        end = start + part["size"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            F.coalesce(end, seen["at"]).alias("at"),
            F.when(part["value"] >= rule.least, F.concat(seen["found"], span)).otherwise(seen["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    found = F.aggregate(parts, start, step, lambda seen: seen["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(nothing)


def scan_unseen(blobs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Append to ``ledger`` what the ``rules`` find in those (blob, text) rows that lack them there.

    Copies of a blob are dropped inside each task before the shuffle, so that a blob with a
    third of all rows costs one row per task. A job that dies leaves the ledger as it was; a
    pair scanned twice by two jobs at once is read once.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = blobs.select("blob", "text").dropDuplicates(["blob"])
    known = stored(blobs.sparkSession, ledger, LEDGER)
    if known is None:
        todo = todo.withColumn("lacking", wanted)
    else:
        done = known.groupBy("blob").agg(
            F.flatten(F.collect_set(F.transform("results", lambda r: r["rule"]))).alias("done")
        )
        lacking = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.join(done, "blob", "left").withColumn("lacking", lacking).where(F.size("lacking") > 0)
    results = [
        F.when(F.array_contains("lacking", r.key),
               F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    found = todo.select("blob", F.filter(F.array(*results), lambda r: r.isNotNull()).alias("results"))
    found.write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` (any columns, with ``blob``) with ``found``: array of (start, rank, end, kind), sorted.

    A blob without findings has an empty array. Only blobs with findings take part in the join.
    """
    names = [r.name for r in rules]
    keys = F.array(*[F.lit(r.key) for r in rules])
    rank = F.array_position(keys, F.col("result.rule")).cast("int")
    span = F.col("result.spans")
    each = (
        stored(versions.sparkSession, ledger, LEDGER)
        .select("blob", F.explode("results").alias("result"))
        .where((rank > 0) & (F.size(span) > 0))
        .select("blob", F.transform(span, lambda s: F.struct(
            s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"),
            F.element_at(F.array(*[F.lit(n) for n in names]), rank).alias("kind"),
        )).alias("spans"))
    )
    by_blob = each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("found"))
    joined = salted_join(versions, by_blob, "blob", "left", hot_keys(versions, "blob"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return joined.withColumn("found", F.coalesce("found", empty))


def scan(versions: DataFrame, keys: list[str], ledger: str | None = None, text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(keys, blob, found) for every row of ``versions``, in any number, copies and repeated rows included.

    ``keys`` name a version (path, revision) and may be NULL; other columns are ignored. NULL
    texts are empty and, like texts without matches and unlike missing rows, have an empty
    ``found``; an empty table gives an empty one. ``ledger`` is a shared folder that later scans
    pass again; without it a fresh one is used.
    """
    ledger = ledger or scratch_path(versions.sparkSession, "ledger")
    whole = text_of(text)
    scan_unseen(versions.select(digest(whole).alias("blob"), whole.alias("text")), ledger, rules)
    return findings(versions.select(*keys, digest(whole).alias("blob")), ledger, rules)


def spelled(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
