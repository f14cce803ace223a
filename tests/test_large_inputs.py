"""Exact answers where inputs outgrow the plain way: vocabularies, phrases, long pairs, order statistics."""

import itertools
import random
from collections import Counter

import pytest
from loomset.functions import overlap
from loomset.operators import augment, encode, split
from loomset.runtime import scratch_path  # noqa: F401
from loomset.schema import TEXT_KIND
from pyspark.sql import functions as F


def zipf(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(f"w{int(words ** rng.random())}" for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("capacity", [1, 40, 100, 100_000])
def test_heavy_vocabulary_is_the_whole_one(rows, monkeypatch, capacity):
    texts = zipf(1, 400, 5000) + [None, "", "</s> <unk> </s> w1"]
    frame = rows([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4)
    fell_back = []
    plain = encode.build_vocab
    monkeypatch.setattr(encode, "build_vocab", lambda *a, **k: fell_back.append(1) or plain(*a, **k))
    got = encode.heavy_vocab(frame, "text", size=10, capacity=capacity)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain(frame, "text", size=10).collect()))
    assert bool(fell_back) == (capacity == 1)


def test_summaries_hold_few_words_and_bound_what_they_lost():
    rng = random.Random(2)
    words = [f"w{int(3000 ** rng.random())}" for _ in range(20_000)]
    counts, margin = Counter(), 0
    for w in words:
        counts[w] += 1
        if len(counts) > 200:
            margin += encode.shrink(counts, 100)
    true = Counter(words)
    assert len(counts) <= 200 < len(true) and 0 < margin <= len(words) / 100
    assert all(counts[w] <= n <= counts[w] + margin for w, n in true.items())


def test_heavy_vocabulary_of_two_columns_and_no_words(rows):
    frame = rows([("a b", "b c"), (None, "c c")], "x string, y string")
    assert sorted(map(tuple, encode.heavy_vocab(frame, "x", "y", size=2).collect())) == sorted(
        map(tuple, encode.build_vocab(frame, "x", "y", size=2).collect())
    )
    assert encode.heavy_vocab(frame.where("false"), "x", size=5).count() == 2


def leftmost_longest(words, phrases):
    i, out = 0, []
    while i < len(words):
        fit = [p for p in phrases if tuple(words[i : i + len(p)]) == p]
        if fit:
            best = max(fit, key=len)
            out.append((i, best))
            i += len(best)
        else:
            i += 1
    return out


def test_phrases_from_the_left_the_longest_first():
    rng = random.Random(3)
    for _ in range(400):
        phrases = {tuple(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))}
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        number = {w: i for i, w in enumerate("abc", 1)}
        assert augment.phrase_matches(words, number, augment.phrase_automaton(phrases, number)) == leftmost_longest(words, phrases)


def test_phrases_change_as_one_word(rows):
    lexicon = rows([("New York", "Paris"), ("New York City", "Rome"), ("York City", "none"), ("big", "small"), (" ", "x")], "word string, replacement string")
    texts = rows([(1, "big New\nYork City and New York"), (2, None), (3, ""), (4, "York New")], "id int, text string")
    out = augment.augment(texts, TEXT_KIND, "id", 2, "synonym", lexicon, share=1.0, most=None).where("copy_no = 1")
    assert {r.id: r.text for r in out.collect()} == {1: "small Rome and Paris", 2: None, 3: "", 4: "York New"}
    one = augment.augment(texts, TEXT_KIND, "id", 2, "synonym", lexicon, share=0.0).where("copy_no = 1 and id = 1").first().text
    assert one in {"small New York City and New York", "big Rome and New York", "big New York City and Paris"}
    with pytest.raises(ValueError):
        augment.augment(texts, TEXT_KIND, "id", 2, "synonym", lexicon, inline_limit=0)


def test_matches_and_bits_agree_on_subsequences():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdef"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert overlap.lcs_by_matches(a, b) == overlap.lcs_by_bits(a, b)


def test_very_long_pairs_go_by_their_matches(monkeypatch):
    n = 200_000
    a = [f"w{i}" for i in range(n)]
    b = list(itertools.chain.from_iterable(zip(a[::4], (f"x{i}" for i in range(n)))))
    monkeypatch.setattr(overlap, "lcs_by_bits", lambda a, b: pytest.fail("too many bits"))
    assert overlap.lcs_length(a, b) == n // 4
    monkeypatch.undo()
    monkeypatch.setattr(overlap, "lcs_by_matches", lambda a, b: pytest.fail("too many matches"))
    assert overlap.lcs_length(["a"] * 6000, ["a"] * 500) == 500


def test_rank_is_found_digit_by_digit(rows, monkeypatch):
    frame = rows([(i,) for i in range(500)], "id int")
    hashed = frame.select(split.split_hash(F.col("id")).alias("h"), F.col("id").cast("string").alias("k"))
    order = sorted(map(tuple, hashed.collect()))
    for fraction in (0.0, 0.1, 0.5, 1.0):
        for digits, most in ((1, 1), (2, 5), (5, 100_000)):
            got = split._at_rank(hashed, fraction, digits, most)
            rank = -(-int(fraction * 1000) * 500 // 1000)
            assert (got is None) if rank == 0 else tuple(got) == order[rank - 1]
    same = rows([(7,)] * 50 + [(8,)] * 50, "id int")
    assert split.split_sizes(split.with_split(same, "id")).where("split = 'test'").first().n == 50
    tied = rows([("0" * 32, f"{i % 3}") for i in range(30)], "h string, k string")
    assert split._at_rank(tied, 0.5, 1, 1).k == "1"
    assert split._at_rank(rows([], "h string, k string"), 0.5) is None


def test_shuffle_files_of_a_written_table_go_with_the_write(spark):
    import glob
    import time

    from pyspark.sql import functions as F
    from loomset.runtime import CLEANUP_KEY, materialise

    jvm = spark.sparkContext._jvm
    folders = [str(d) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before, setting = held(), spark.conf.get(CLEANUP_KEY, "false")
    written = materialise(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):  # the files are removed in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert written.count() == 100 and spark.conf.get(CLEANUP_KEY) == setting
