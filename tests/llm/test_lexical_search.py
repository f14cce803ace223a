import math
import random
import re
from collections import Counter, defaultdict

import corpora
from loomset.llm import lexical_search as ls

ITEMS = "item_id bigint, text string, doc_id bigint, score string, term int"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, top=20):
    """Every document against every item."""
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    having = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in set(items):
        scored = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m))
                for w in words(text) if w in bag
            )
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def items(rng):
    made = [(i, corpora.prose(rng, rng.randrange(1, 25), 400)) for i in range(30)]
    return made + [(90, None), (91, ""), (92, " \t!? "), (93, "NAÏVE Café 日本語 w1 w1 w1"), made[3], (None, made[4][1]), (95, "no_such-word"), (96, "w5 " * 300)]


def search(rows, docs, asked, **options):
    frame = rows([(i, t, 7, "clash", 1) for i, t in asked], ITEMS)
    return ls.search(corpora.frame(rows, docs), frame, **options)


def test_ranks_are_those_of_every_pair(rows):
    rng = random.Random(4)
    docs = corpora.documents(4)
    copies = [(5000 + i, corpora.prose(random.Random(77), 60, 300), "src0") for i in range(300)]  # a class of many documents
    shuffled = copies[0][1].split()
    rng.shuffle(shuffled)
    docs += copies + [(4000, " ".join(shuffled).upper(), "src1")]  # the same bag in another text
    asked = items(rng) + [(97, copies[0][1])]
    want = brute([(i, t) for i, t, _ in docs], asked)
    got = sorted((tuple(r) for r in search(rows, docs, asked).collect()), key=str)
    assert got == want
    top = [r for r in got if r[0] == 97]
    assert [r[2] for r in sorted(top, key=lambda r: r[1])] == [4000] + list(range(5000, 5019))
    small_blocks = sorted((tuple(r) for r in search(rows, docs, asked, block_bytes=600).collect()), key=str)
    assert small_blocks == want


def test_joined_classes_give_the_same(rows, monkeypatch):
    docs, asked = corpora.documents(5), items(random.Random(5))
    want = brute([(i, t) for i, t, _ in docs], asked, 7)
    monkeypatch.setattr(ls, "small", lambda df, size: False)
    assert sorted((tuple(r) for r in search(rows, docs, asked, top=7).collect()), key=str) == want


def test_hash_collisions_do_not_merge_bags(rows, monkeypatch):
    docs, asked = corpora.documents(6), items(random.Random(6))
    monkeypatch.setattr(ls.F, "xxhash64", lambda *columns: ls.F.lit(1).cast("bigint"))
    got = search(rows, docs, asked).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(i, t) for i, t, _ in docs], asked)


def test_empty_tables(rows):
    assert search(rows, [], items(random.Random(1))).count() == 0
    assert search(rows, corpora.documents(1), []).count() == 0
    assert search(rows, [(1, None, "a"), (2, "", "a")], [(1, "w1")]).count() == 0
    assert search(rows, corpora.documents(1), [(1, None)]).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_of_items_against_sorting():
    import numpy as np

    rng = random.Random(3)
    best, seen = ls.Best(5, 4), defaultdict(list)
    for _ in range(40):
        scores = np.array([[rng.randrange(-2, 6) for _ in range(5)] for _ in range(7)])
        first, number = np.array([rng.randrange(30) for _ in range(7)]), np.array([rng.randrange(10**6) for _ in range(7)])
        best.add(scores, first, number)
        for r in range(7):
            for i in range(5):
                if scores[r, i] > 0:
                    seen[i].append((-scores[r, i], first[r], number[r]))
    kept = best.prune()
    got = [(int(i), -int(s), int(f), int(c)) for i, s, f, c in zip(*kept)]
    assert got == [(i, *map(int, row)) for i in range(5) for row in sorted(seen[i])[:4]]
