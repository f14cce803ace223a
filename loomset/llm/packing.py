"""Packing documents into token sequences by bin completion.

Spark encodes, cuts and counts pieces by length; a plan of patterns is made from the counts of at
most ``capacity`` lengths; pieces are then ranked within their length and joined to their places.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomset.llm.bins import complete
from loomset.llm.common import BROADCAST_ROWS, slices, text_of
from loomset.llm.token_ids import encoder
from loomset.runtime import materialise

CAPACITY = 2048
END = (0).to_bytes(4, "little")  # the id that ends a document

_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(ids: bytes, capacity: int) -> list[dict[str, int]]:
    """The pieces of one document's 32-bit ids: all of ``capacity`` but the first, which takes what is over."""
    n = len(ids) // 4
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [
        {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], n]))
    ]


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's whole text and its end id."""

    @F.arrow_udf(_PIECES)
    def encode(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([cut(ids + END, capacity) for some in slices(texts) for ids in own.ids(some)], pa.list_(_PIECE))

    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(encode(text_of(text))))


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``length``.

    Ranks within a length are local ranks in the parts in which the table was written plus the
    sizes of the parts before, so that a length with a third of all pieces is spread. The
    places of a length are runs of ranks, as many as patterns hold it: some thousands for all the
    corpus, as the fillings that a plan looks at are bounded. They are broadcast up to a checked number.
    """
    spark = cut_pieces.sparkSession
    rows = materialise(cut_pieces.withColumn("part", F.spark_partition_id()), "pieces")
    counts = materialise(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, base = [], 0
    taken = dict.fromkeys(sizes, 0)
    for pattern in complete(sizes, capacity):
        offset = 0
        for size in sorted(set(pattern.sizes), reverse=True):
            each = pattern.sizes.count(size)
            slots.append((size, taken[size], taken[size] + each * pattern.times, base, offset, each))
            taken[size] += each * pattern.times
            offset += each * size
        base += pattern.times
    slot_table = spark.createDataFrame(slots, "length bigint, low bigint, high bigint, base bigint, at bigint, each bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("local", F.row_number().over(inside) - 1).join(starts.hint("merge"), ["length", "part"])  # laid out for it by the window
    ranked = ranked.withColumn("rank", F.col("first") + F.col("local"))
    within = (ranked["length"] == slot_table["length"]) & (ranked["rank"] >= slot_table["low"]) & (ranked["rank"] < slot_table["high"])
    return ranked.join(F.broadcast(slot_table) if len(slots) <= BROADCAST_ROWS else slot_table, within).select(
        *[ranked[c] for c in cut_pieces.columns],
        F.expr("base + (rank - low) div each").alias("sequence_id"),
        (F.col("at") + (F.col("rank") - F.col("low")) % F.col("each") * ranked["length"]).alias("offset"),
    )


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Every row of ``docs`` is a document: a NULL text is empty and has the end id alone; numbers
    may be NULL or repeat; an empty table gives an empty one; other columns are ignored. Only
    documents longer than ``capacity`` are cut. ``path`` is a tokenizer file that all workers have.
    """
    return place(pieces(docs, path, doc_id, text, capacity), capacity)
