"""Near-duplicate documents by circulant MinHash and exact Jaccard verification.

Two permutations make all signature coordinates: the first deals a shingle to a position of the
universe, the second gives the value there, and coordinate k reads the second shifted by k. The
coordinates of a shingle are thus one contiguous window of the second permutation. Bands of
coordinates propose candidates, and every candidate pair whose ends are not linked otherwise is
verified on the full shingle sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import HOT_KEYS, HOT_ROWS, hot_keys, salted_join, slices, text_of, unused
from loomset.llm.components import components
from loomset.llm.words import shingles
from loomset.runtime import materialise

# A pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**50 = 3e-7.
ROWS = 6
BANDS = 50
UNIVERSE_BITS = 20
BLOCK = 256  # documents of a candidate group that meet those of another block in one task
BLOCK_SHINGLES = 1 << 20  # and about so many shingles at most
_STEP = 512
_FIRST = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _windows() -> np.ndarray:
    """Row p: the second permutation at p, p + 1, ..., one value per coordinate, circularly."""
    size = 1 << UNIVERSE_BITS
    second = np.random.Generator(np.random.PCG64(20)).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: ROWS * BANDS]]), ROWS * BANDS)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The ``ROWS * BANDS`` minima of a non-empty set, in blocks of bounded memory."""
    mixed = (shingle_set ^ (shingle_set >> np.uint64(32))) * _FIRST
    at = (mixed >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    lowest = None
    for i in range(0, len(at), _STEP):
        part = _windows()[at[i : i + _STEP]].min(axis=0)
        lowest = part if lowest is None else np.minimum(lowest, part)
    return lowest


def band_keys(shingle_set: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included; none for an empty set."""
    if not len(shingle_set):
        return np.empty(0, np.int64)
    rows = signature(shingle_set).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def set_key(shingle_set: np.ndarray) -> bytes | None:
    """128-bit digest of the set: documents with equal keys form a class. None for an empty set."""
    return xxhash.xxh3_128_digest(shingle_set.tobytes()) if len(shingle_set) else None


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted sets."""
    less, more = sorted((len(a), len(b)))
    if 100 * less < percent * more:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (less + more - both)


def links_between(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents that share a band.

    With two sides, only pairs across are examined. Pairs with the most common bands come first;
    a pair whose ends are already joined is skipped, as it cannot change a component.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    across = bool(side.any()) and not bool(side.all())
    seconds, firsts, shared = [], [], []
    for i in range(1, len(sets)):
        common = (bands[:i] == bands[i]).sum(axis=1)
        if across:
            common = np.where(side[:i] != side[i], common, 0)
        at = np.flatnonzero(common)
        firsts.append(at)
        seconds.append(np.full(len(at), i))
        shared.append(common[at])
    if not firsts:
        return []
    first, second, common = (np.concatenate(x) for x in (firsts, seconds, shared))
    forest = []
    for k in np.argsort(-common, kind="stable").tolist():
        i, j = int(first[k]), int(second[k])
        x, y = find(i), find(j)
        if x != y and linked(sets[i], sets[j], percent):
            root[y] = x
            forest.append((i, j))
    return forest


def _content(whole: Column) -> Column:
    return F.unhex(F.md5(whole))


def sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, content, set_key, n_shingles, bands), one row per row; ``content`` is the text's MD5."""

    @F.arrow_udf("struct<set_key:binary,n_shingles:bigint,bands:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        keys, sizes, bands = [], [], []
        for some in slices(texts):
            for one in some:
                s = shingles(one, words)
                keys.append(set_key(s))
                sizes.append(len(s))
                bands.append(band_keys(s))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])])
        values = np.concatenate([np.empty(0, np.int64), *bands])
        return pa.StructArray.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))],
            names=["set_key", "n_shingles", "bands"],
        )

    whole = text_of(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"), _content(whole).alias("content"), sketch(whole).alias("s")
    ).select("doc_id", "content", "s.*")


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """(content, group, n_shingles) of the classes that share a band with another, by 64-bit class number.

    Every class of a bucket is tied to the bucket's least class; groups are the components.
    Bucket sizes and minima are combined before the shuffle. Equal numbers of different
    classes would only put more candidates into a group.
    """
    banded = classes.select("number", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("number").alias("least"), F.max("number").alias("most"), F.count("*").alias("n"))
    shared = materialise(shared.where("least < most").select("band", "least", "n"), "buckets")
    hot = [r[0] for r in shared.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).select("band").collect()]
    ties = salted_join(banded, shared.select("band", "least"), "band", "inner", hot)
    groups = components(ties.select(F.col("least").alias("a"), F.col("number").alias("b")))
    return classes.select("number", "content", "n_shingles").join(
        groups.select(F.col("node").alias("number"), F.col("label").alias("group")), "number"
    )


def _verified_links(docs: DataFrame, members: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(a, b): set keys of linked classes, enough of them to span every component.

    A group is cut into blocks by hash, and each pair of blocks meets in one task, so that no
    task holds more than two blocks however large the group. A text travels once for a group
    of one block.
    """
    sizes = members.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = salted_join(members, sizes, "group", "inner", hot_keys(members, "group")).select(
        "content", "group", "blocks", F.pmod(F.xxhash64("number", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    )
    whole = text_of(text)
    texts = docs.select(_content(whole).alias("content"), whole.alias("text")).dropDuplicates(["content"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = texts.join(placed.dropDuplicates(["content"]), "content").select("group", "block", "text", other).select(
        "group", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "text"
    )

    def verify(table: pa.Table) -> pa.Table:
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        side = np.array(table.column("block")) != one
        sets = [shingles(t.as_py(), words) for t in table.column("text")]
        bands = np.array([band_keys(s) for s in sets])
        keys = [set_key(s) for s in sets]
        found = links_between(sets, bands, side, percent) if one == two or side.any() and not side.all() else []
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})

    return met.groupBy("group", "one", "two").applyInArrow(verify, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, content, n_shingles, class_id, group_id, component_id, kept), one row per row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; a document with fewer words has one shingle, one without words
    or with a NULL text has none and is linked with nothing. ``component_id`` is the least
    document number that links can reach; ``kept`` marks the documents that bear it. Documents
    with equal sets form a class, ``class_id``, and are compared once; ``group_id`` names the
    component by one of its classes. Both are NULL without words. Documents without a number
    take part through their texts; their ``component_id`` is NULL, and they are kept, only if no
    document of the component has a number. Repeated rows are all returned. ``content`` is the
    text's MD5. Other columns are ignored.
    """
    rows = materialise(sketches(docs, doc_id, text, words), "sketches")
    full = rows.where("set_key is not null")
    one_each = full.dropDuplicates(["set_key"]).select("set_key", "content", "n_shingles", "bands")
    classes = materialise(one_each.withColumn("number", F.xxhash64("set_key")), "classes")
    members = materialise(_candidate_groups(classes), "members")
    links = materialise(_verified_links(docs, members, text, words, percent), "links")
    found = components(links).select(F.col("node").alias("set_key"), "label")
    named = full.groupBy("set_key").agg(F.min("doc_id").alias("least_id")).join(found, "set_key", "left")
    named = named.withColumn("label", F.coalesce("label", "set_key"))
    named = materialise(named, "labels")
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = salted_join(named.select("set_key", "label"), least, "label", "inner", hot_keys(named, "label"))
    joined = salted_join(full.drop("bands"), named, "set_key", "left", hot_keys(full, "set_key"))
    alone = rows.where("set_key is null").drop("bands").withColumns(
        {"label": F.lit(None).cast("binary"), "component_id": F.col("doc_id")}
    )
    hexed = lambda name: F.lower(F.hex(name))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.unionByName(alone).select(
        "doc_id", "content", "n_shingles", hexed("set_key").alias("class_id"), hexed("label").alias("group_id"),
        "component_id", kept.alias("kept"),
    )


def _row_key(doc_id: Column, content: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.hex(content)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: one document of each component.

    That is the one with the least number, a missing number being the greatest, then the least
    content hash. Rows equal in number and text count as one document, of which one row stays.
    Documents without words stay. Names of extra columns do not matter.
    """
    judged = near_duplicates(docs, doc_id, text, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "content")
    best = judged.where("group_id is not null").groupBy("group_id").agg(F.min(order).alias("w")).select("w.doc_id", "w.content")
    stays = best.union(judged.where("group_id is null").select("doc_id", "content"))
    key = unused(docs, "row_key")
    stays = stays.select(_row_key(F.col("doc_id"), F.col("content")).alias(key)).distinct()
    keyed = docs.withColumn(key, _row_key(F.col(doc_id), _content(text_of(text)))).dropDuplicates([key])
    return keyed.join(stays, key, "left_semi").select(*docs.columns)
