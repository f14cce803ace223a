import random

import pytest

from loomset.operators import losses

SCHEMA = "run_id long, step long, train_loss double, eval_loss double"


def brute_stop(evals, patience):
    best, bad = None, 0
    for step, loss in evals:
        if best is None or loss < best:
            best, bad = loss, 0
        else:
            bad += 1
        if bad >= patience:
            return step
    return None


@pytest.mark.parametrize("block", [10_000, 7, 1])
@pytest.mark.parametrize("patience", [1, 3])
def test_early_stop_in_any_blocks(spark, block, patience):
    rng = random.Random(4)
    runs = {r: [(s, float(rng.randrange(12))) for s in sorted(rng.sample(range(200), rng.randrange(1, 40)))] for r in range(20)}
    runs[100] = [(s, 100.0 - s) for s in range(50)]  # always better
    runs[101] = [(s, 1.0) for s in range(50)]  # flat
    runs[102] = [(s, float(s)) for s in range(50)]  # always worse
    data = [(r, s, None, l) for r, e in runs.items() for s, l in e] + [(r, 300, 1.0, None) for r in runs]
    got = {r.run_id: r.stop_step for r in losses.early_stop_step(spark.createDataFrame(data, SCHEMA), patience, block).collect()}
    want = {r: s for r, e in runs.items() if (s := brute_stop(e, patience)) is not None}
    assert got == want
    assert 100 not in got and got[101] == got[102] == patience


def test_patience_zero_is_off(rows):
    assert losses.early_stop_step(rows([(1, 1, None, 1.0)], SCHEMA), 0).count() == 0


def test_log_curve_final_best(rows):
    df = rows([(1, 10, 0.123456, None), (1, 10, None, 0.5), (1, 20, 0.1, None), (1, 20, None, 0.5), (1, 30, None, 0.9)], SCHEMA)
    assert [tuple(r) for r in losses.loss_log(df).orderBy("step").collect()] == [(1, 10, 0.1235, None), (1, 20, 0.1, None)]
    assert [tuple(r) for r in losses.loss_curve(df).orderBy("step").collect()] == [
        (1, 10, 0.1235, 0.5), (1, 20, 0.1, 0.5), (1, 30, None, 0.9),
    ]
    assert tuple(losses.final_loss(df).first()) == (1, 20, 0.1)
    assert tuple(losses.best_step(df).first()) == (1, 10, 0.5)
    assert losses.loss_curve(df.limit(0)).count() == 0
