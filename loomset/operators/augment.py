"""Row replication and reproducible word-level augmentation."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from loomset.functions.text import bind, tokens
from loomset.runtime import BROADCAST_BYTES, hot_keys, materialise, salted_join
from loomset.schema import INSTRUCTION_KIND, Kind, TEXT_KIND

# Share of the words to change, and the least and most words per text.
SHARE = 0.3
LEAST = 1
MOST = 10

SEED = 42
BROADCAST_ENTRIES = 524_288  # lexicons up to this many rows are sent to every worker
BROADCAST_PHRASES = 32_768  # the same if entries have several words, whose automaton is many times their size


def replicate(df: DataFrame, factor: int = 2) -> DataFrame:
    """Each row ``factor`` times, with ``copy_no`` 0 for the original."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


class Extent(NamedTuple):
    """How many words of a text change: a share of them, within bounds; no upper bound with None."""

    share: float = SHARE
    least: int = LEAST
    most: int | None = MOST

    def of(self, n: Column) -> Column:
        wanted = F.floor(n * self.share)
        capped = wanted if self.most is None else F.least(F.lit(self.most), wanted)
        return F.greatest(F.lit(self.least), capped).cast("int")

    def number(self, n: int) -> int:
        wanted = int(n * self.share)
        return max(self.least, wanted if self.most is None else min(self.most, wanted))


def augment(df: DataFrame, kind: Kind, key: str, factor: int = 2, method: str = "synonym",
            lexicon: DataFrame | None = None, seed: int = SEED,
            inline_limit: int = BROADCAST_ENTRIES, share: float = SHARE, least: int = LEAST,
            most: int | None = MOST) -> DataFrame:
    """Originals plus ``factor - 1`` changed copies, told apart by ``copy_no``.

    ``synonym`` and ``spelling`` replace words found in ``lexicon`` (word, replacement);
    ``random_word`` deletes words, keeping at least one. Which words change is a hash of
    (seed, key, copy, position). Texts, else instructions, are changed; copies of
    preferences stay as they are. ``share`` of a text's words change, at least ``least`` and
    at most ``most`` (None: no such bound).

    Entries may have several words. A text is then cut into matches from the left, the longest one first
    at each place, and each match changes as one word would, by the position of its first one. A lexicon
    may have any size: one too large for the workers is joined, and the rows are then read more than once.
    """
    extent = Extent(share, least, most)
    column = {TEXT_KIND: "text", INSTRUCTION_KIND: "instruction"}.get(kind)
    copies = replicate(df, factor)
    if column is None:
        return copies
    salt = F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col("copy_no").cast("string"))
    changes = (F.col("copy_no") > 0) & F.col(column).isNotNull()
    if method == "random_word":
        return copies.withColumn(column, F.when(changes, _without_words(F.col(column), salt, extent)).otherwise(F.col(column)))
    if lexicon is None:
        raise ValueError(f"{method} needs a lexicon of (word, replacement)")
    lexicon = materialise(lexicon.select("word", "replacement").where("word is not null and replacement is not null"), "lexicon")
    rows, size, longest = lexicon.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("replacement")), F.lit(0)), F.max(F.size(tokens("word")))
    ).first()
    phrases = (longest or 0) > 1
    if rows <= (min(inline_limit, BROADCAST_PHRASES) if phrases else inline_limit) and size <= BROADCAST_BYTES:
        replace = (_phrase_replacer if phrases else _replacer)(df.sparkSession, lexicon.collect(), extent)
        changed = replace(F.when(changes, F.col(column)), salt)  # originals do not travel to Python
        return copies.withColumn(column, F.coalesce(changed, F.col(column)))
    lengths = _lengths(lexicon) if phrases else [1]
    return _replace_by_join(copies, key, column, lexicon, lengths, seed, extent)


def _lengths(lexicon: DataFrame) -> list[int]:
    """How many words the entries have."""
    return sorted(n for n, in lexicon.select(F.size(tokens("word"))).distinct().collect() if n)


def _without_words(text: Column, salt: Column, extent: Extent) -> Column:
    def shorten(words: Column) -> Column:
        spots = F.transform(
            words, lambda _, i: F.struct(F.md5(F.concat_ws("-", salt, i.cast("string"))).alias("h"), i.alias("i"))
        )
        n = F.least(extent.of(F.size(words)), F.size(words) - 1)
        gone = F.transform(F.slice(F.sort_array(spots), F.lit(1), n), lambda s: s["i"])
        left = bind(gone, lambda g: F.filter(words, lambda _, i: ~F.array_contains(g, i)))
        return F.when(F.size(words) > 1, F.array_join(left, " ")).otherwise(text)

    return bind(tokens(text), shorten)


def _hash(*parts: object) -> str:
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def _spot(salt: str, position: int) -> bytes:
    """The same hash of a position, as bytes, which order like its digits."""
    return hashlib.md5(f"{salt}-{position}".encode()).digest()


def _pick(options: list[str], spot: bytes) -> str:
    return options[0] if len(options) == 1 else min(options, key=lambda r: _hash(spot.hex(), r))


def _replacer(spark: SparkSession, entries: list[Row], extent: Extent):
    options: dict[str, list[str]] = {}
    for word, replacement in entries:
        options.setdefault(word, []).append(replacement)
    shared = spark.sparkContext.broadcast(options)

    def change(text: str | None, salt: str) -> str | None:
        if text is None:
            return None
        words = text.split()
        known = shared.value
        hits = [(_spot(salt, i), i) for i, w in enumerate(words) if w in known]
        if not hits:
            return text
        for h, i in heapq.nsmallest(extent.number(len(words)), hits):
            words[i] = _pick(known[words[i]], h)
        return " ".join(words)

    def change_all(texts: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([change(t, s) for t, s in zip(texts, salts)], dtype="object")

    return F.pandas_udf(change_all, "string")


def phrase_automaton(phrases: Iterable[tuple[str, ...]], number: dict[str, int]) -> ahocorasick.Automaton:
    """An automaton over the numbers of words, which finds all places of all phrases in one pass."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        found.add_word(tuple(number[w] for w in phrase), phrase)
    found.make_automaton()
    return found


def phrase_matches(words: list[str], number: dict[str, int], automaton: ahocorasick.Automaton) -> list[tuple[int, tuple[str, ...]]]:
    """(first position, phrase) of the matches from the left, the longest one at each place.

    ``number`` has no 0, which stands for words of no phrase.
    """
    longest: dict[int, tuple[str, ...]] = {}
    for end, phrase in automaton.iter(tuple(number.get(w, 0) for w in words)):
        start = end - len(phrase) + 1
        if len(phrase) > len(longest.get(start, ())):
            longest[start] = phrase
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            out.append((start, longest[start]))
            free = start + len(longest[start])
    return out


def _phrase_replacer(spark: SparkSession, entries: list[Row], extent: Extent):
    options: dict[tuple[str, ...], list[str]] = {}
    for phrase, replacement in entries:
        if words := tuple(phrase.split()):
            options.setdefault(words, []).append(replacement)
    shared = spark.sparkContext.broadcast(options)
    built: list[tuple[dict[str, int], ahocorasick.Automaton]] = []

    def change(text: str | None, salt: str) -> str | None:
        if text is None:
            return None
        words, known = text.split(), shared.value
        hits = [(_spot(salt, i), i, p) for i, p in phrase_matches(words, *built[0])]
        if not hits:
            return text
        for h, i, p in heapq.nsmallest(extent.number(len(words)), hits):
            words[i : i + len(p)] = [_pick(known[p], h)] + [None] * (len(p) - 1)
        return " ".join(w for w in words if w is not None)

    def change_all(texts: pd.Series, salts: pd.Series) -> pd.Series:
        if not built:  # once per task, from the lexicon that its worker has
            number = {w: i for i, w in enumerate(sorted({w for p in shared.value for w in p}), 1)}
            built.append((number, phrase_automaton(shared.value, number)))
        return pd.Series([change(t, s) for t, s in zip(texts, salts)], dtype="object")

    return F.pandas_udf(change_all, "string")


def _replace_by_join(copies: DataFrame, key: str, column: str, lexicon: DataFrame, lengths: list[int], seed: int, extent: Extent) -> DataFrame:
    """The same with a lexicon of any size, whose words or runs of words join it; texts move once, to meet their hits.

    What changes in a text follows from it, its key and its copy, which stand for the row. Single words
    join in the order in which they would change, no more of a text than can, and more
    only if some are not in the lexicon. Runs of words, of the ``lengths`` that entries have, all join, by hashes; what
    they meet is compared in the text.
    """
    changes = (F.col("copy_no") > 0) & F.col(column).isNotNull()
    salt = F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col("copy_no").cast("string"))
    texts = copies.where(changes).withColumns({"_key": salt, "_text": F.xxhash64(F.col(column))})
    phrases = lengths != [1]
    found = _phrase_hits(texts, column, lexicon, lengths) if phrases else _word_hits(texts, column, lexicon, extent)
    text = bind(tokens(column), lambda words: _with_hits(words, F.col("_key"), F.col("_hits"), extent, phrases))
    met = texts.join(found, ["_key", "_text"], "left")
    met = met.withColumn(column, F.when(F.size("_hits") > 0, F.coalesce(text, F.col(column))).otherwise(F.col(column)))
    return copies.where(~changes).unionByName(met.select(*copies.columns))


def _spot_at(salt: Column, position: Column) -> Column:
    return F.md5(F.concat_ws("-", salt, position.cast("string")))


def _met(candidates: DataFrame, lexicon: DataFrame, how: str) -> DataFrame:
    """The words of texts with what the lexicon has for their (code).

    Only hot words are salted, so that a lexicon grouped by code joins the others where it has been grouped.
    """
    candidates = materialise(candidates, "candidates")
    hot = hot_keys(candidates, "code")
    if not hot:
        return candidates.join(lexicon, "code", how)
    is_hot = F.col("code").isin(hot)
    rest = candidates.where(~is_hot).join(lexicon.where(~is_hot), "code", how)
    return rest.unionByName(salted_join(candidates.where(is_hot), lexicon.where(is_hot), "code", how, hot))


def _first_spots(extent: Extent, turn: int):
    """(size, asked): the number of words of a text, and those of its words that are asked for in a round, in order of their spots."""

    @F.arrow_udf("struct<size:int,asked:array<struct<pos:int,code:string>>>")
    def first(texts: pa.Array, salts: pa.Array) -> pa.Array:
        sizes, ends, places, asked = [], [0], [], []
        for text, salt in zip(texts, salts):
            words, salt = text.as_py().split(), salt.as_py()
            most = extent.number(len(words))
            spots = heapq.nsmallest(most * 4**turn, [(_spot(salt, i), i) for i in range(len(words))])
            own = [i for _, i in spots[most * 4 ** (turn - 1) if turn else 0 :]]
            sizes.append(len(words))
            places += own
            asked += [words[i] for i in own]
            ends.append(len(places))
        each = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(asked, pa.string())], names=["pos", "code"])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["size", "asked"])

    return first


def _word_hits(texts: DataFrame, column: str, lexicon: DataFrame, extent: Extent) -> DataFrame:
    """(_key, _text, _hits): the words that may change, at least as many as do.

    Words join in the order of their spots: first as many as may change, then, of texts in which too few of
    these are in the lexicon, three times as many as before, and so on.
    """
    # Not written: what is grouped by word joins in the same shuffle.
    options = lexicon.groupBy(F.col("word").alias("code")).agg(F.collect_set("replacement").alias("options"))
    options = options.withColumn("n", F.lit(1))
    hit = F.struct("pos", "n", "options")
    rounds, still = [], None
    while True:
        turn = len(rounds)
        asked = texts if still is None else texts.join(still.select("_key", "_text"), ["_key", "_text"], "left_semi")
        # What stands beside a generator is computed per word: the texts are left behind first.
        split = asked.select("_key", "_text", _first_spots(extent, turn)(F.col(column), F.col("_key")).alias("_spots"))
        split = split.select("_key", "_text", extent.of(F.col("_spots.size")).alias("_most"), F.col("_spots.size").alias("_size"), F.col("_spots.asked").alias("_asked"))
        words = split.select("_key", "_text", "_most", "_size", F.inline_outer("_asked")).where("pos is not null")
        met = _met(words, options, "left").groupBy("_key", "_text", "_most", "_size").agg(
            F.collect_set(F.when(F.col("n").isNotNull(), hit)).alias("_hits")
        )
        rounds.append(materialise(met, "hits"))
        had = rounds[-1].select("_key", "_text", "_most", "_size", F.size("_hits").alias("_had"))
        if still is not None:
            before = still.select("_key", "_text", F.col("_had").alias("_before"))
            had = had.join(before, ["_key", "_text"]).withColumn("_had", F.col("_had") + F.col("_before")).drop("_before")
        still = materialise(had.where((F.col("_had") < F.col("_most")) & (F.col("_size") > F.col("_most") * 4**turn)), "still")
        if still.isEmpty():
            break
    found = [r.where(F.size("_hits") > 0).select("_key", "_text", "_hits") for r in rounds]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.union, found).groupBy("_key", "_text").agg(F.flatten(F.collect_list("_hits")).alias("_hits"))


def _phrase_hits(texts: DataFrame, column: str, lexicon: DataFrame, lengths: list[int]) -> DataFrame:
    """(_key, _text, _hits): the runs of words whose hashes entries of the lexicon have."""
    entry = lexicon.select(tokens("word").alias("words"), "replacement").where(F.size("words") > 0)
    options = entry.groupBy("words").agg(F.collect_set("replacement").alias("options"))
    options = options.select(F.xxhash64("words").alias("code"), F.size("words").alias("n"), F.array_join("words", " ").alias("phrase"), "options")
    # Entries of one hash stay together, so that a word meets one row.
    options = materialise(options.groupBy("code").agg(F.collect_list(F.struct("n", "phrase", "options")).alias("entries")), "options")
    runs = lambda words, n: F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))),
        lambda _, i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, F.lit(n))).alias("code")),
    )
    split = texts.select("_key", "_text", bind(tokens(column), lambda words: F.concat(*[runs(words, n) for n in lengths])).alias("_asked"))
    words = split.select("_key", "_text", F.inline_outer("_asked")).where("pos is not null")
    met = _met(words, options, "inner").select("_key", "_text", "pos", F.inline("entries"))
    return met.groupBy("_key", "_text").agg(F.collect_set(F.struct("pos", "n", "phrase", "options")).alias("_hits"))


def _with_hits(words: Column, salt: Column, hits: Column, extent: Extent, phrases: bool) -> Column:
    """The text of ``words`` with the first of the hits changed; NULL if it has none."""
    if phrases:
        stands = F.filter(hits, lambda s: F.array_join(F.slice(words, s["pos"] + 1, s["n"]), " ") == s["phrase"])
        order = F.array_sort(F.transform(stands, lambda s: F.struct(s["pos"].alias("pos"), (-s["n"]).alias("less"), s["n"].alias("n"), s["options"].alias("options"))))
        none = F.struct(F.lit(0).alias("free"), F.filter(order, lambda _: F.lit(False)).alias("taken"))
        hits = F.aggregate(
            order, none,
            lambda done, s: F.when(s["pos"] < done["free"], done).otherwise(
                F.struct((s["pos"] + s["n"]).alias("free"), F.array_append(done["taken"], s).alias("taken"))
            ),
            lambda done: done["taken"],
        )

    def change(chosen: Column) -> Column:
        new = lambda s: F.array_min(F.transform(s["options"], lambda r: F.struct(F.md5(F.concat_ws("-", s["h"], r)).alias("h"), r.alias("r"))))["r"]
        places = F.flatten(F.transform(chosen, lambda s: F.transform(
            F.sequence(F.lit(0), s["n"] - 1),
            lambda i: F.struct((s["pos"] + i).alias("pos"), F.when(i == 0, F.array(new(s))).otherwise(F.array().cast("array<string>")).alias("new")),
        )))
        changed = bind(F.map_from_entries(places), lambda m: F.flatten(F.transform(words, lambda w, i: F.coalesce(F.try_element_at(m, i), F.array(w)))))
        return F.when(F.size(chosen) > 0, F.array_join(changed, " "))

    spots = F.transform(hits, lambda s: F.struct(_spot_at(salt, s["pos"]).alias("h"), s["pos"].alias("pos"), s["n"].alias("n"), s["options"].alias("options")))
    return bind(F.slice(F.array_sort(spots), F.lit(1), extent.of(F.size(words))), change)


def augment_report(augmented: DataFrame) -> DataFrame:
    """(original, augmented) row counts."""
    return augmented.agg(
        F.count_if(F.col("copy_no") == 0).alias("original"), F.count("*").alias("augmented")
    )
