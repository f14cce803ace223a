import itertools
import random
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict

import corpora
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from loomset.llm import bins, packing, token_cache
from loomset.llm.token_ids import Encoder
from loomset.runtime import scratch_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OWN = Encoder(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(" \t\n\r\x0b\x1c\x85\xa0 a'sétlŁ1.<|endoftext|>", max_size=40) | st.text(max_size=30) | st.text(st.characters(max_codepoint=0x17F), max_size=60), max_size=4))
def test_ids_are_those_of_the_library(texts):
    assert OWN.ids(texts) == [array("I", ids(t)).tobytes() for t in texts]


def test_every_common_character_and_pair():
    common = [c for c in map(chr, range(0x180)) if OWN.plain(c)]
    assert len(common) > 250
    texts = [a + b for a in common for b in common[::5]] + [f"x{a}{a} {a}y\n{a}" for a in common]
    assert all(map(OWN.plain, texts))
    want = [array("I", e.ids).tobytes() for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert OWN.ids(texts) == want


def test_special_strings_and_long_words():
    texts = ["a <|endoftext|> b", "<|endoftext|>", " x  <|endoftext|>y", "q" * 30000, "", " ", "  a  b  ", "don't we'll I'm", "日本語 𝒳 " * 50]
    assert OWN.ids(texts) == [array("I", ids(t)).tobytes() for t in texts]
    assert [OWN.plain(t) for t in texts] == [False, False, False, False, True, True, True, True, False]


def test_other_kinds_of_file_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, plain = Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Words of ünusual form", "", "a  b"]
    assert not other.plain(texts[0])
    assert other.ids(texts) == [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_counts_and_cache(spark, rows):
    cache = scratch_path(spark, "cache")
    data = corpora.documents(4)
    docs = corpora.frame(rows, data)
    got = token_cache.count_tokens(docs, ["doc_id"], PATH, cache).collect()
    want = Counter((i, len((t or "").encode()), len(ids(t))) for i, t, _ in data)
    assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, _ in data})
    more = docs.union(corpora.frame(rows, [(9, "a new text", "s")]))
    assert Counter(tuple(r) for r in token_cache.count_tokens(more, ["doc_id"], PATH, cache).collect()) == want + Counter([(9, 10, 3)])
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_cache.count_tokens(docs.limit(0), ["doc_id"], PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plans_hold_every_piece(sizes):
    plan = bins.complete(dict(Counter(sizes)), 40)
    held = Counter()
    for p in plan:
        assert sum(p.sizes) <= 40 and p.times > 0
        for s in p.sizes:
            held[s] += p.times
    assert held == Counter(sizes)
    n = sum(p.times for p in plan)
    counts = [Counter(sizes)[s] for s in range(41)]
    assert bins.least_bins(dict(Counter(sizes)), 40) <= n <= sum(p.times for p in bins.best_fit(counts, 40))


@pytest.mark.parametrize("n", [100, 10_000, 1_000_000])
def test_hot_sizes_are_packed_without_waste(n):
    sizes = {60: n, 52: n, 30: n, 18: n, 10: n, 20: 2 * n}  # the fullest bins first would need 2.2n
    plan = bins.complete(sizes, 100)
    assert bins.gap(plan, sizes, 100) == 0 and sum(p.times for p in plan) == 21 * n // 10
    assert all(sum(p.times * p.sizes.count(s) for p in plan) == k for s, k in sizes.items())


@pytest.mark.parametrize("seed,n", [(0, 3_000), (1, 200_000)])
def test_plans_of_many_sizes_come_near_the_bound(seed, n):
    rng = random.Random(seed)
    sizes = dict(Counter(min(2048, int(rng.lognormvariate(6, 0.8)) + 1) for _ in range(n)))
    assert bins.gap(bins.complete(sizes, 2048), sizes, 2048) <= 2


def test_plans_take_little_memory():
    rng = random.Random(1)
    sizes = dict(Counter(rng.randint(1, 1100) for _ in range(20_000)))
    tracemalloc.start()
    bins.complete(sizes, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # 112 MB where all choices of a search held their fillings


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80), st.integers(1, 3), st.integers(0, 1))
def test_choices_listed_anew_change_no_plan(sizes, live, above):
    counts = [Counter(sizes)[s] for s in range(31)]
    target = bins.least_bins(dict(Counter(sizes)), 30) + above
    whole = bins.search(counts, 30, target, 1000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bins, "LIVE", live)
        assert bins.search(counts, 30, target, 1000) == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(0, 14))
def test_fillings_are_all_that_no_other_dominates(sizes, room):
    counts = [Counter(sizes)[s] for s in range(15)]
    subsets = {tuple(sorted(c, reverse=True)) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room}
    got = [f for f in bins.fillings(counts, room) if f is not None]
    assert len(got) == len(set(got)) and set(got) <= subsets
    for s in subsets:
        assert any(bins._dominates(f, s) for f in got)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_are_the_best_there_are(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(2, 14) for _ in range(10)]

    def best(left, open_bins, most):
        if len(open_bins) >= most:
            return most
        if not left:
            return len(open_bins)
        for i in range(len(open_bins)):
            if open_bins[i] >= left[0] and open_bins[i] not in open_bins[:i]:
                most = min(most, best(left[1:], open_bins[:i] + [open_bins[i] - left[0]] + open_bins[i + 1 :], most))
        return min(most, best(left[1:], open_bins + [15 - left[0]], most))

    want = best(sorted(sizes, reverse=True), [], 11)
    assert sum(p.times for p in bins.complete(dict(Counter(sizes)), 15)) == want


def check_packing(data, got, capacity):
    """Every document is there once, cut as told, and sequences have no gaps."""
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for spans in of.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for i, t in data:
        x = array("I", ids(t) + [0])
        first = len(x) % capacity or capacity
        starts = [0, *range(first, len(x), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)])):
            want[i, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(of)


def test_packing_of_awkward_documents(rows):
    data = corpora.documents(5)
    for capacity in (2048, 64):
        got = packing.pack(corpora.frame(rows, data).repartition(4), PATH, capacity=capacity).collect()
        n = check_packing([(i, t) for i, t, _ in data], got, capacity)
        least = bins.least_bins(dict(Counter(r.length for r in got)), capacity)
        assert least <= n <= least + 2
    assert packing.pack(corpora.frame(rows, []), PATH).count() == 0
