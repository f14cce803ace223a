"""Document fingerprints as homomorphic multiset hashes. DataFrame functions only.

A text is a multiset of passages: what stands between line breaks and sentence or phrase ends.
Each passage is hashed to a wide vector of bytes, and a fingerprint is the sum of the vectors
modulo a power of two, lane by lane, with the number of passages as first lane. The hash is not
cryptographic: fingerprints tell texts apart, not forgeries. The order of
passages does not matter, and passages can be added or taken away without the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomset.llm.common import text_of
from loomset.runtime import materialise

LANES = 64
_HASHES = LANES // 8  # 64-bit hashes of a passage, each seeded with its number; every byte is a lane
BITS = 24  # a lane counts modulo 2**BITS
PASSAGE_END = r"\n|(?<=[.,;:!?])\x20+"
LAST_END = r"^(?s:.*)(?:\n|[.,;:!?]\x20+)(?=[^\x20])"
_APART = 32  # two lanes share a 64-bit sum, so many bits apart
_ALL = (1 << BITS) - 1
_BOTH = _ALL << _APART | _ALL
_BYTES = 0x000000FF000000FF
_MEAN = 127.5


def passages(text: Column) -> Column:
    """The non-blank passages of a text, in order, repeats included."""
    return F.filter(F.split(text, PASSAGE_END, -1), lambda p: F.trim(p) != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: lambda bodies repeat what they mention."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The lanes of a text: array<int> of 1 + LANES numbers below 2**BITS; all 0 without passages."""
    hashed = F.transform(passages(text), lambda p: F.array(*[F.xxhash64(F.lit(i), p) for i in range(_HASHES)]))
    zero = F.array(*[F.lit(0).cast("bigint")] * _HASHES)

    def sums(hashed: Column, shift: int) -> Column:
        """Two byte lanes of each hash, summed over all passages."""
        add = lambda total, h: (total + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_BYTES))).bitwiseAND(F.lit(_BOTH))
        return F.aggregate(hashed, zero, lambda acc, hashes: F.zip_with(acc, hashes, add))

    def lanes(hashed: Column) -> Column:
        pairs = F.concat(*[sums(hashed, 8 * k) for k in range(4)])
        split = F.flatten(F.transform(pairs, lambda s: F.array(F.shiftrightunsigned(s, _APART), s.bitwiseAND(F.lit(_ALL)))))
        counted = F.size(hashed).cast("bigint").bitwiseAND(F.lit(_ALL))
        return F.concat(F.array(counted), split).cast("array<int>")

    return _let(hashed, lanes)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts together (``sign`` 1), or of ``a`` without ``b``'s passages (-1)."""
    return F.zip_with(a, b, lambda x, y: (x + y * sign).bitwiseAND(F.lit(_ALL)))


def changed_passages(text: Column, kept: Column, new: Column) -> tuple[Column, Column]:
    """What to take from and add to the fingerprint of ``text`` if ``new`` stands after its first ``kept`` characters.

    Only what follows the last passage end within the kept part: as it was, and as it is now.
    """
    at = F.length(F.regexp_extract(F.left(text, kept), LAST_END, 0))
    old = F.substring(text, at + 1, F.length(text) - at)
    return fingerprint(old), fingerprint(F.concat(F.substring(text, at + 1, kept - at), new))


def spelled(lanes: Column) -> Column:
    """Six hexadecimal digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the lanes about their mean, an estimate of the share of common passages.

    1 for equal fingerprints, 0 if one of two different ones has no passages. Random lanes of
    texts without common passages differ from 0 by about 1 / sqrt(LANES).
    """
    centred = lambda f: F.transform(F.slice(f, 2, LANES), lambda x: x - f[0] * _MEAN)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(centred(a), centred(b), lambda x, y: x * y))
    norm = lambda f: total(F.transform(centred(f), lambda x: x * x))
    cosine = dot / F.sqrt(norm(a) * norm(b))
    return F.when(a == b, 1.0).when((a[0] == 0) | (b[0] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for the distinct numbers, the greatest being followed by the least.

    Ranges of numbers are linked inside by a window over each range; the last of a range is
    linked with the first of the next by a table of one row per range.
    """
    ranged = materialise(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    bounds = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    ahead = Window.orderBy("part")
    firsts = bounds.select(
        "part", F.coalesce(F.lead("first").over(ahead), F.min("first").over(Window.partitionBy())).alias("first_ahead")
    )
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("next_id", inside).join(firsts, "part").select(
        "doc_id", F.coalesce("next_id", "first_ahead").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, lanes, edited_lanes, near_edited, near_next) for every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many,
    or all, of the next document's, by ascending number; the greatest is followed by the
    least. A NULL text is empty. Of rows with equal numbers, the next document is the one whose
    text has the least MD5; each of them is followed by the next greater number. A row without
    a number follows none and is followed by the least number, or by an empty text if there is
    none. Repeated rows are all returned; an empty table gives an empty one; other columns are
    ignored. Texts are shuffled once, by number; what a document lends to the one before
    travels alone.
    """
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    keyed = docs.select(own.alias("k"), text_of(text).alias("text"))
    following = materialise(_successors(docs.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct()), "successors")
    first = following.agg(F.min("doc_id")).first()[0]
    quarter = F.floor(F.length("text") / 4).cast("int")
    follows = following.select(F.col("doc_id").cast("string").alias("k"), F.col("next_id").cast("string").alias("next_k"))
    asked = keyed.groupBy("k").agg(F.max(quarter).alias("asked")).join(follows, "k", "left")
    asked = asked.select("k", F.coalesce("next_k", F.lit(None if first is None else str(first))).alias("next_k"), "asked")
    asked = materialise(asked, "asked")
    lender = asked.where("next_k is not null").select(F.col("k").alias("to_k"), F.col("next_k").alias("k"), "asked")
    offers = keyed.join(lender, "k").select("to_k", "k", F.struct(F.md5("text").alias("md5"), F.left("text", F.col("asked")).alias("head")).alias("offer"))
    lent = offers.groupBy("to_k").agg(F.min("offer").alias("offer"), F.min("k").alias("next_k"))
    lent = lent.select(F.col("to_k").alias("k"), "next_k", F.col("offer.md5").alias("next_md5"), F.col("offer.head").alias("head"))
    kept = F.length("text") - quarter
    new = F.left(F.coalesce("head", F.lit("")), quarter)
    gone, come = changed_passages(F.col("text"), kept, new)
    done = keyed.join(lent, "k", "left").select(
        "k", "next_k", "next_md5", F.md5("text").alias("md5"), F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.concat(F.left("text", kept), new), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("lanes"), gone.alias("gone"), come.alias("come"),
    )
    done = materialise(done, "fingerprints")
    edited = combine(combine(F.col("lanes"), F.col("gone"), -1), F.col("come"))
    done = done.select("k", "next_k", "next_md5", "md5", "n_chars", "edited_sha256", "lanes", edited.alias("edited_lanes"))
    ahead = done.select(F.col("k").alias("next_k"), F.col("md5").alias("next_md5"), F.col("lanes").alias("next_lanes")).dropDuplicates(["next_k", "next_md5"])
    near = done.join(ahead, ["next_k", "next_md5"], "left")
    nothing = fingerprint(F.lit(""))
    return near.select(
        F.expr("cast(nullif(k, '') as bigint)").alias("doc_id"), "n_chars", "edited_sha256", "lanes", "edited_lanes",
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.coalesce("next_lanes", nothing)).alias("near_next"),
    )
