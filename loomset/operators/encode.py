"""Word vocabulary and padded, masked, labelled token ids."""

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomset.functions.text import tokens
from loomset.operators.batching import with_ordinal
from loomset.runtime import materialise, small_table

# The last-resort end token, the unknown token, the id losses ignore, usual lengths.
END_TOKEN = "</s>"
UNKNOWN_TOKEN = "<unk>"
IGNORED_LABEL = -100
MAX_LENGTH = 256
PREFERENCE_MAX_LENGTH = 512

PAD_ID, UNKNOWN_ID = 0, 1
BROADCAST_WORDS = 262_144  # vocabularies up to this many rows are sent to every worker
_SALTS = 16


def pad_token(eos: str | None = None, bos: str | None = None, unk: str | None = None) -> str:
    """Padding uses the end token, which falls back to begin, unknown, then a fixed one."""
    return eos or bos or unk or END_TOKEN


def build_vocab(df: DataFrame, *columns: str, size: int) -> DataFrame:
    """(token, id, n): the padding/end and unknown tokens, then the ``size`` most frequent words.

    Counting combines map-side, so a hot word costs one row per task. Up to
    ``BROADCAST_WORDS`` winners are ranked together, more by ranges of counts.
    """
    words = F.concat(*[tokens(c) for c in columns]) if len(columns) > 1 else tokens(columns[0])
    counts = (
        df.select(F.explode_outer(words).alias("token"))
        .where(F.col("token").isNotNull() & ~F.col("token").isin(END_TOKEN, UNKNOWN_TOKEN))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return _ranked(counts, size)


def _ranked(counts: DataFrame, size: int) -> DataFrame:
    """The vocabulary of counted words (token, n)."""
    order = [F.desc("n"), F.asc("token")]
    if size <= BROADCAST_WORDS:
        ranked = counts.orderBy(*order).limit(size).select(
            "token", (F.row_number().over(Window.orderBy(*order)) + UNKNOWN_ID).cast("int").alias("id"), "n"
        )
    else:
        placed = with_ordinal(counts.withColumn("_rarity", -F.col("n")), "_rarity", "token", name="_rank")
        ranked = placed.where(F.col("_rank") < size).select(
            "token", (F.col("_rank") + UNKNOWN_ID + 1).cast("int").alias("id"), "n"
        )
    specials = counts.sparkSession.createDataFrame(
        [(END_TOKEN, PAD_ID, 0), (UNKNOWN_TOKEN, UNKNOWN_ID, 0)], "token string, id int, n long"
    )
    return specials.union(ranked)


def heavy_vocab(df: DataFrame, *columns: str, size: int, capacity: int | None = None) -> DataFrame:
    """As :func:`build_vocab` without a shuffle of all words, where they are too many for that.

    Each task keeps a summary of at most about ``capacity`` words (four times ``size`` unless given):
    counts that are too low by no more than the task's margin. Margins add up, and a word that no
    summary has occurs at most as often as all margins together. The words that may be among the
    first ``size`` are counted again exactly; if the last of these is above the sum of margins, no
    other word can be, and they are the result. If not, all words are counted. Texts are read twice.
    """
    capacity = capacity or max(4 * size, 1024)
    texts = df.select(*[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)])
    summary = materialise(texts.mapInPandas(_summariser(capacity), "token string, n long, margin long"), "summary")
    margin = summary.agg(F.coalesce(F.sum("margin"), F.lit(0))).first()[0]
    least = summary.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    if margin == 0:
        return _ranked(least, size)
    least = materialise(least, "least")
    # The word of rank ``size`` occurs at least this often.
    bound = least.select(F.col("n")).orderBy(F.desc("n")).limit(size).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    if bound["k"] == size and size > 0:
        candidates = small_table(least.where(F.col("n") + margin >= bound["n"]).select("token"), BROADCAST_WORDS, F.octet_length("token"))
        if candidates is not None:
            exact = texts.mapInPandas(_counter({r["token"] for r in candidates}), "token string, n long")
            exact = materialise(exact.groupBy("token").agg(F.sum("n").alias("n")), "exact")
            last = exact.orderBy(F.desc("n")).limit(size).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
            if last["k"] == size and last["n"] > margin:
                return _ranked(exact, size)
    return build_vocab(df, *columns, size=size)


def shrink(counts: Counter, capacity: int) -> int:
    """Take so much from every count that at most ``capacity`` words are left, and say how much."""
    taken = heapq.nlargest(capacity + 1, counts.values())[-1]
    for word in [w for w, n in counts.items() if n <= taken]:
        del counts[word]
    for word in counts:
        counts[word] -= taken
    return taken


def _summariser(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, margin = Counter(), 0
        for frame in frames:
            for column in frame:
                for text in frame[column]:
                    if text is not None:
                        counts.update(text.split())
                    if len(counts) > 2 * capacity:
                        margin += shrink(counts, capacity)
        yield _word_rows(counts).assign(margin=0)
        yield pd.DataFrame({"token": [None], "n": [0], "margin": [margin]})

    return run


def _counter(wanted: set[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()
        for frame in frames:
            for column in frame:
                for text in frame[column]:
                    if text is not None:
                        counts.update(filter(wanted.__contains__, text.split()))
        yield _word_rows(counts)

    return run


def _word_rows(counts: Counter) -> pd.DataFrame:
    for special in (END_TOKEN, UNKNOWN_TOKEN):
        counts.pop(special, None)
    return pd.DataFrame({"token": list(counts), "n": list(counts.values())}).astype({"token": object, "n": "int64"})


def token_ids(df: DataFrame, key: str, columns: dict[str, str], vocab: DataFrame, max_length: int,
              inline_limit: int = BROADCAST_WORDS) -> DataFrame:
    """Add an id array per ``{new column: text column}``, cut to ``max_length``.

    A vocabulary within ``inline_limit`` rows and a bound of bytes (both checked) travels to the workers and the
    rows never shuffle. A larger one is joined: see :func:`_ids_by_join`.
    """
    entries = small_table(vocab.select("token", "id"), inline_limit, F.octet_length("token") + 4)
    if entries is not None:
        shared = df.sparkSession.sparkContext.broadcast(dict(entries))

        def to_ids(texts: pd.Series) -> pd.Series:
            ids = shared.value
            return texts.map(
                lambda t: [] if t is None else [ids.get(w, UNKNOWN_ID) for w in t.split(None, max_length)[:max_length]]
            )

        encode = F.pandas_udf(to_ids, "array<int>")
        return df.withColumns({new: encode(F.col(c)) for new, c in columns.items()})
    for new, column in columns.items():
        df = _ids_by_join(df, new, column, vocab, max_length)
    return df


def _ids_by_join(df: DataFrame, new: str, column: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """The same by joining words to a vocabulary of any size.

    Each word is salted by its row and the vocabulary repeated per salt, so that a hot
    word spreads; regrouping holds at most ``max_length`` ids per row. Rows get numbers of
    their own, written with them: keys may be missing or repeat, as where nothing is joined.
    """
    df = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    salt = F.pmod(F.xxhash64("_row", "pos"), F.lit(_SALTS)).cast("int")
    words = df.select(
        "_row", F.posexplode_outer(F.slice(tokens(column), 1, max_length)).alias("pos", "token")
    ).withColumn("_salt", salt)
    spread = vocab.select(
        "token", F.col("id").alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")
    )
    found = words.join(spread, ["token", "_salt"], "left").select(
        "_row",
        F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("id"))).alias("at"),
    )
    rows = found.groupBy("_row").agg(
        F.transform(F.sort_array(F.collect_list("at")), lambda p: p["id"]).alias(new)
    )
    return df.join(rows, "_row", "left").drop("_row")


def pad(ids: Column, max_length: int, pad_id: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(ids)))


def attention_mask(ids: Column, max_length: int) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(max_length) - F.size(ids))
    )


def causal_labels(input_ids: Column, pad_id: int = PAD_ID) -> Column:
    """A copy of the ids with padding (and so any real end token) ignored by the loss."""
    return F.transform(input_ids, lambda i: F.when(i == pad_id, F.lit(IGNORED_LABEL)).otherwise(i))


def encode(df: DataFrame, key: str, column: str, vocab: DataFrame, max_length: int = MAX_LENGTH,
           **options) -> DataFrame:
    """(key, input_ids, attention_mask, labels), all of length ``max_length``."""
    rows = token_ids(df.select(key, column), key, {"_ids": column}, vocab, max_length, **options)
    return _arrays(rows, key, max_length)


def encode_with(df: DataFrame, key: str, column: str, load: Callable[[], Callable[[str], list[int]]],
                max_length: int = MAX_LENGTH) -> DataFrame:
    """:func:`encode` with the caller's own tokenizer, loaded on the workers."""

    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load()
        for texts in batches:
            yield texts.map(lambda t: list(codec(t or ""))[:max_length])

    udf = F.pandas_udf(to_ids, "array<int>")
    return _arrays(df.select(key, udf(F.col(column)).alias("_ids")), key, max_length)


def _arrays(rows: DataFrame, key: str, max_length: int) -> DataFrame:
    ids = F.col("_ids")
    padded = rows.select(
        key, pad(ids, max_length).alias("input_ids"), attention_mask(ids, max_length).alias("attention_mask")
    )
    return padded.withColumn("labels", causal_labels(F.col("input_ids")))


def encode_preference(df: DataFrame, key: str, vocab: DataFrame, max_length: int = PREFERENCE_MAX_LENGTH,
                      **options) -> DataFrame:
    """Ids and masks of the chosen and the rejected text; other columns are dropped."""
    rows = token_ids(
        df.select(key, "chosen", "rejected"), key, {"_chosen": "chosen", "_rejected": "rejected"},
        vocab, max_length, **options,
    )
    out = [F.col(key)]
    for side in ("chosen", "rejected"):
        ids = F.col(f"_{side}")
        out += [
            pad(ids, max_length).alias(f"input_ids_{side}"),
            attention_mask(ids, max_length).alias(f"attention_mask_{side}"),
        ]
    return rows.select(*out)
