import random
from collections import Counter, defaultdict

import corpora
import numpy as np
from loomset.llm import near_dups as nd
from loomset.llm.components import components


def brute_force(data, words):
    """{row index: (n_shingles, component_id, kept)} by comparing all texts."""
    sets = []
    for _, t, _ in data:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        least = min((data[i][0] for i in members if data[i][0] is not None), default=None)
        out += [(data[i][0], len(sets[i]), least, data[i][0] == least) for i in members]
    return Counter(out)


def test_components_equal_brute_force(rows, monkeypatch):
    data = corpora.documents(3)
    docs = corpora.frame(rows, data).repartition(5)
    for words in (2, 5):
        for block in (256, 4):
            monkeypatch.setattr(nd, "BLOCK", block)
            got = nd.near_duplicates(docs, words=words).collect()
            assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_force(data, words)


def test_one_of_each(rows):
    data = corpora.documents(3)
    docs = corpora.frame(rows, data)
    got = nd.one_of_each(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    want = Counter()
    for (i, _, least, stays), _n in brute_force(data, 5).items():
        want[least] += stays
    numbered = {i for i, _ in kept if i is not None}
    assert numbered == {i for i, n in want.items() if n and i is not None}
    assert max(kept.values()) == 1
    assert {(3000, ""), (3001, None), (3002, " \t\n "), (None, None)} <= set(kept)


def test_empty_table_and_no_words(rows):
    assert nd.near_duplicates(corpora.frame(rows, [])).count() == 0
    got = nd.near_duplicates(corpora.frame(rows, [(1, "", "a"), (2, None, "a")])).collect()
    assert {(r.doc_id, r.component_id, r.kept, r.class_id) for r in got} == {(1, 1, True, None), (2, 2, True, None)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**9), 400)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    chain, star = min(names[:151]), min(names[200:300])
    assert got == {**{n: chain for n in names[:151]}, **{n: star for n in names[200:300]}}


def test_signature_is_circulant_and_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1800], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((nd.signature(a) == nd.signature(b)).mean() - exact) < 0.1
    one = nd.signature(a[:1])
    assert (nd._windows()[1:] [0][:-1] == nd._windows()[0][1:]).all() and len(one) == nd.ROWS * nd.BANDS
