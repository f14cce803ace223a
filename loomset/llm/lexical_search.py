"""Ranked lexical search over classes of equal bags.

Only terms of the items matter to a score, so a document is cut down to its bag: how often it has
each of these terms, and its length norm ``m``. Documents with equal bags and norms form a class,
found by hash and confirmed on the bags themselves; a class is scored once, and only the classes
that reach an item's top are expanded to their documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from loomset.llm.common import hot_keys, salted_join, slices, small, text_of
from loomset.runtime import materialise

TOP = 20
BLOCK_BYTES = 4 << 20  # text of the items that are searched for together
PAIRS_AT_ONCE = 4_000_000  # postings that a task unfolds at once
ROWS_AT_ONCE = 64

# Fixed values of the score: length norm 75 + 25 * n * N div L, saturation 1000 and 12, scale of the weights and of the counts.
FLAT, SLOPE, WEIGHT_SCALE, COUNT_SCALE, COUNT_FACTOR, NORM_FACTOR = 75, 25, 1000, 1_000_000_000, 1000, 12

# Digits, letters (A-Z as a-z) and all beyond ASCII make terms; every other byte is a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LAST = np.iinfo(np.int64).max  # stands for a NULL number, which comes after all others


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def weight(documents: int, having: int) -> int:
    """A term's weight when ``having`` of ``documents`` have it."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * having + 1)))


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``terms`` are numbers of the vocabulary, rising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.__contains__
        for batch in batches:
            sizes, numbers, counts = [], [], []
            for some in slices(batch.column("text")):
                for text in some:
                    words = terms(text)
                    bag = sorted((vocabulary[t], k) for t, k in Counter(filter(known, words)).items())
                    sizes.append(len(words))
                    numbers.append([t for t, _ in bag])
                    counts.append([k for _, k in bag])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>").where("n > 0")


class Postings:
    """For each term the items that ask for it, each with the weight times the repeats in the item."""

    def __init__(self, items: list[list[int]], weights: dict[int, int], terms: int):
        asked = sorted((t, i, k * weights[t]) for i, item in enumerate(items) for t, k in Counter(item).items() if t in weights)
        by_term = np.array([t for t, _, _ in asked], np.int64)
        self.item = np.array([i for _, i, _ in asked], np.int64)
        self.value = np.array([v for _, _, v in asked], np.int64)
        self.start = np.searchsorted(by_term, np.arange(terms + 1))
        self.items = len(items)

    def scores(self, rows: np.ndarray, n_rows: int, terms: np.ndarray, tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Scores by row and item of the bags whose entries (row, term, tf) are given."""
        held = (COUNT_SCALE * tfs) // (COUNT_FACTOR * tfs + NORM_FACTOR * norms[rows])
        span = self.start[terms + 1] - self.start[terms]
        entry = np.repeat(np.arange(len(terms)), span)
        at = np.arange(len(entry)) + np.repeat(self.start[terms] - np.cumsum(span) + span, span)
        out = np.zeros(n_rows * self.items, np.int64)
        np.add.at(out, rows[entry] * self.items + self.item[at], held[entry] * self.value[at])
        return out.reshape(n_rows, self.items)


class Best:
    """The ``top`` best (score, first document) of each item, of what has been added."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.new.append([item, scores[row, item], first[row], number[row]])
        self.waiting += len(row)
        if self.waiting > 4 * self.top * len(self.least):
            self.prune()

    def prune(self) -> list[np.ndarray]:
        """(item, score, first, class), the best of each item in order."""
        item, score, first, number = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((number, first, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, last = order[place < self.top], item[place == self.top - 1]
        self.kept = [c[order] for c in (np.concatenate(x) for x in zip(self.kept, *self.new))]
        self.least[last] = self.kept[1][np.searchsorted(self.kept[0], last, side="right") - 1]
        self.new, self.waiting = [], 0
        return self.kept


def _best_classes(classes: DataFrame, postings: Postings, top: int) -> DataFrame:
    """(item, score, first, class): of every task's classes the best of each item."""
    rows_at_once = max(1, min(ROWS_AT_ONCE, PAIRS_AT_ONCE // max(1, len(postings.item))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(postings.items, top)
        for batch in batches:
            norms, number = (batch.column(c).to_numpy() for c in ("m", "class"))
            first = pc.fill_null(batch.column("first"), int(_LAST)).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            numbers, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            for low in range(0, batch.num_rows, rows_at_once):
                high = min(low + rows_at_once, batch.num_rows)
                rows, part = np.repeat(np.arange(high - low), sizes[low:high]), slice(ends[low], ends[high])
                scores = postings.scores(rows, high - low, numbers[part], tfs[part], norms[low:high])
                best.add(scores, first[low:high], number[low:high])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.prune()], names=["item", "score", "first", "class"])

    return classes.mapInArrow(run, "item bigint, score bigint, first bigint, class bigint")


def _first(df: DataFrame, top: int, by: list[str], *order) -> DataFrame:
    """The first ``top`` rows of each ``by``; tasks cut theirs to as many before they are dealt."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= top)


def _search_block(docs: DataFrame, items: list[tuple], top: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    words = [terms((text or "").encode()) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*words)))}
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item bigint, item_id {item_type}")

    bags = materialise(_bags(docs, vocabulary), "bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.sum("n")).first()
    bags = bags.where(F.size("terms") > 0)
    having = bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = {r["term"]: weight(n_docs, r["count"]) for r in having}
    postings = Postings([[vocabulary[t] for t in ws] for ws in words], weights, len(vocabulary))

    norm = F.expr(f"{FLAT} + ({SLOPE} * n * {n_docs}L) div {n_terms or 1}L")
    bags = bags.select("doc_id", norm.alias("m"), "terms", "tfs", F.xxhash64("terms", "tfs").alias("hash"))
    classes = bags.groupBy("hash", "m", "terms", "tfs").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    # An item's best documents lie in its best classes, as each class before another has a document before all of the other's.
    winners = _first(_best_classes(classes, postings, top), top, ["item"], F.desc("score"), "first", "class")
    winners = materialise(winners.select("item", "score", "class"), "winners")

    wanted = classes.join(winners.select("class").distinct(), "class", "left_semi").select(
        "class", "hash", "m", F.col("terms").alias("class_terms"), F.col("tfs").alias("class_tfs")
    )
    wanted = materialise(wanted, "wanted")
    if small(wanted, F.lit(64) + 8 * F.size("class_terms")):
        met = bags.join(F.broadcast(wanted), ["hash", "m"])
    else:
        met = salted_join(bags, wanted.withColumnRenamed("m", "class_m"), "hash", "inner", hot_keys(bags, "hash")).where("m = class_m")
    members = met.where("terms = class_terms and tfs = class_tfs").select("class", "doc_id")
    members = _first(members, top, ["class"], F.asc_nulls_last("doc_id")).select("class", "doc_id")
    found = _first(winners.join(members, "class"), top, ["item"], F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.join(F.broadcast(names), "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal ones by number.

    NULL and empty texts have no terms and are never found, nor do they find anything. Numbers of
    documents are whole ones; a NULL comes after all others, and rows with equal numbers are found
    one by one. Equal rows of ``items`` are answered once; an item without a term has no rows. An
    empty table on either side gives an empty one; other columns are ignored. Items are taken in
    blocks of about ``block_bytes`` of text, each with a pass over all documents; a block's terms
    and weights go to every task.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("text")).where("text <> ''").distinct()
    asked = materialise(asked, "items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    found = [
        _search_block(rows, sorted(map(tuple, asked.where(block == b).collect()), key=str), top, asked.schema["item_id"].dataType.simpleString())
        for b in range(blocks)
    ]
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)
