"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a budget of words. It takes whole epochs first; what remains goes to its
documents in the order of exponential keys scaled by their quality (Efraimidis and Spirakis),
by prefix sums of their sizes. No source has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomset.llm.common import text_of, unused
from loomset.runtime import materialise

# The weights of sources in order, repeating, and how often a source may be used.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def quality(text: Column) -> Column:
    """In (0, 1]: the fewer mark-up symbols among the characters, the higher."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u in (0, 1) drawn from the hash of seed and document number."""
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("none"))))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / quality


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size), one row per source.

    Sources in key order weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most_epochs`` times its source's size and the rest is shared anew. With the
    sources in the order in which they stop, the level of all others follows from two running
    sums. This one step works on the table of sources as a whole, not on documents.
    """
    at = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights)
    weighed = sizes.select(
        "source_key", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("bigint").alias("w"),
        (F.col("source_size") * most_epochs).alias("most"),
    )
    stops = Window.orderBy(F.col("most") / F.col("w"), "source_key")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    whole = stops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("words"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("shares"),
    ).withColumn("stopped", (F.col("words") * F.col("w")).cast("double") / F.col("shares") > F.col("most"))
    # All that have not stopped share what is left at the first of them.
    first = F.min(F.when(~F.col("stopped"), F.struct(F.col("most") / F.col("w"), "source_key", "words", "shares"))).over(Window.partitionBy())
    share = (first["words"] * F.col("w")).cast("double") / first["shares"]
    return level.select(
        "source_key", "source_size", F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(share).alias("target")
    )


def mix(docs: DataFrame, size: Column, quality: Column, seed: int = 0, doc_id: str = "doc_id", source: str = "source",
        extra: dict[str, Column] | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken, extra...) for every row of ``docs``.

    ``size`` is the words of a row, ``quality`` its positive weight, ``extra`` more columns to
    carry. ``taken`` counts the words the mix takes, repeats included: ``epochs`` times the
    document, and the next document in the order of keys as long as the budget lasts, the last
    one in part; a source takes its target to the word below. A NULL source is a source, the
    last; NULL texts and texts without words take nothing; repeated rows count each. An empty
    table gives an empty one. The draw depends on seed and number only, so that reruns agree.
    """
    carried = extra or {}
    names = [f"carried_{i}" for i in range(len(carried))]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("source_key"),
        size.alias("size"), sampling_key(F.col(doc_id), quality, seed).alias("key"),
        *[c.alias(n) for n, c in zip(names, carried.values())],
    )
    # Ranges of (source, key) spread a large source; written, so that a rerun cannot move a bound.
    order = ["source_key", "key", "doc_id", "size"]
    placed = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = placed.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    parts = materialise(parts, "parts")
    starts = parts.select("source_key", "part", F.coalesce(
        F.sum("part_size").over(Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("start"))
    budgets = targets(parts.groupBy("source_key").agg(F.sum("part_size").alias("source_size")), weights)
    inside = Window.partitionBy("source_key", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    known = summed.join(starts.join(budgets, "source_key"), ["source_key", "part"])
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div greatest(source_size, 1)")).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("start") - F.col("inside")))
    return known.withColumn("epochs", epochs).select(
        "doc_id", F.when(F.col("source_key") != "1", F.substring("source_key", 2, 1 << 30)).alias("source"),
        "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
        *[F.col(n).alias(name) for n, name in zip(names, carried)],
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """``mix`` of whole texts, by words and by their share of mark-up symbols."""
    whole = text_of(text)
    return mix(docs, word_count(whole), quality(whole), seed, doc_id, source)


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them, documents whole.

    A document comes once per epoch and once more if the mix takes at least half of it beyond
    that. Documents without words come as often as their source's epochs. Rows equal in number,
    source and text are copies of one another and share their number of appearances.
    """
    whole = text_of(text)
    identity = lambda: F.md5(F.concat_ws(
        ":", *[F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in (doc_id, source)], F.md5(whole)
    ))
    taken = mix(docs, word_count(whole), quality(whole), seed, doc_id, source, {"identity": identity()})
    drawn = F.when(2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    times = taken.groupBy("identity").agg(F.sum(F.col("epochs") + drawn).cast("int").alias("times")).where("times > 0")
    key, n = unused(docs, "identity"), unused(docs, "times")
    times = times.select(F.col("identity").alias(key), F.col("times").alias(n))
    once = docs.withColumn(key, identity()).dropDuplicates([key]).join(times, key)
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(unused(docs, "turn"))).select(*docs.columns)
