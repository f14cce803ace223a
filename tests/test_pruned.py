import numpy as np
import pytest
from loomset.operators import embedding, pruned

SCHEMA = "pair_id int, side string, pos int, vec array<double>"


def clusters(rng, centres, n):
    return np.concatenate([c + 0.02 * rng.normal(size=(n, len(c))) for c in centres])


def sides(pair, x, y):
    return [(pair, s, i, v.tolist()) for s, m in (("pred", x), ("ref", y)) for i, v in enumerate(m)]


def scores(df):
    return {r.pair_id: pytest.approx((r.p, r.r, r.f1), abs=1e-9) for r in df.collect()}


@pytest.mark.parametrize("block", [4, 64])
def test_same_scores_as_all_pairs(rows, block):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(90, 5)), rng.normal(size=(40, 5))
    x[3], y[7], x[10:30], y[5] = 0, 0, x[10], 3 * x[10]  # zero vectors, equal ones, another length
    centres = 3 * rng.normal(size=(5, 8))
    data = sides(1, x, y) + sides(2, clusters(rng, centres, 30), clusters(rng, centres[1:], 20)) + sides(3, x[:1], y[:1])
    data += sides(4, x[:6], y[:0]) + sides(5, x[:0], y[:6]) + sides(6, -y[:3], y[:9]) + sides(7, x[3:4], y[:9])
    df = rows(data, SCHEMA)
    want = {r.pair_id: (r.p, r.r, r.f1) for r in embedding.embedding_match(df).collect()}
    got = scores(pruned.embedding_match_pruned(df, block))
    assert got.keys() == want.keys() == set(range(1, 8)) and all(want[k] == got[k] for k in want)


def test_far_balls_never_meet(rows):
    rng = np.random.default_rng(12)
    centres = 3 * rng.normal(size=(20, 16))
    found = pruned.balls(rows(sides(1, clusters(rng, centres, 40), clusters(rng, centres, 40)), SCHEMA), 8)
    kept = found.collect()
    assert sorted((r.side, p) for r in kept for p in r.pos) == [(s, i) for s in ("pred", "ref") for i in range(800)]
    n = {s: sum(r.side == s for r in kept) for s in ("pred", "ref")}
    met = pruned.meetings(found, 8).collect()
    assert len({tuple(r) for r in met}) == len(met) < n["pred"] * n["ref"] / 4


def test_no_vectors(rows):
    assert pruned.embedding_match_pruned(rows([], SCHEMA)).count() == 0
