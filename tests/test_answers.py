import os

import pytest
from loomset.operators import answers
from loomset.runtime import scratch_path
from pyspark.sql import functions as F

ROWS = "row_id bigint, prompt string, error string"


def counting(folder, die_at=None):
    """A model that notes every prompt it is asked, and dies when it is asked for one."""

    def score(model, prompts):
        for p in prompts:
            if p is not None and p == die_at:
                os._exit(1)
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.write(f"{p}\n")
        if "bad" in prompts:
            raise ValueError("bad")
        return [f"{model}:{p}" for p in prompts]

    return score


def asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n")[:-1])


def data(rows):
    prompts = [(i, f"p{i % 60}", None) for i in range(120)] + [(200, None, "old"), (201, "", None), (202, "bad", None)]
    return rows(prompts, ROWS).drop("error")


def test_a_job_that_dies_is_run_again_for_the_rest(spark, rows, tmp_path):
    store = scratch_path(spark, "answers")
    run = lambda score: answers.resumed_score(data(rows), store, lambda: "m", score, "m", wave_rows=8)
    first, second, third = (tmp_path / n for n in ("first", "second", "third"))
    for folder in (first, second, third):
        folder.mkdir()
    with pytest.raises(Exception):
        run(counting(str(first), die_at="p7")).count()
    kept = answers.AnswerStore(spark, store).rows().count()
    assert kept < 62
    got = {r.row_id: (r.response, r.error) for r in run(counting(str(second))).collect()}
    assert len(got) == 123 and all(got[i] == (f"m:p{i % 60}", None) for i in range(120))
    assert got[200] == ("m:None", None) and got[201] == ("m:", None) and got[202][0] is None and "ValueError" in got[202][1]
    good = [p for p in asked(second) if p != "bad"]
    assert set(good) <= {f"p{i}" for i in range(60)} | {"None", ""} and len(set(good)) == 62 - kept  # what was committed is not asked again
    run(counting(str(third))).count()
    assert set(asked(third)) == {"bad"}  # only what failed is asked again


def test_settings_and_models_are_other_questions(spark, rows, tmp_path):
    store = scratch_path(spark, "answers")
    some = data(rows).where("row_id < 5")
    run = lambda model, settings: answers.resumed_score(some, store, lambda: model, counting(str(tmp_path)), model, settings).collect()
    run("a", {"t": 0})
    run("a", {"t": 0})
    assert len(asked(tmp_path)) == 5
    run("a", {"t": 1})
    assert {r.response for r in run("b", {"t": 0})} == {f"b:p{i}" for i in range(5)}
    assert len(asked(tmp_path)) == 15


def test_answers_of_two_jobs_agree(spark, rows):
    store = answers.AnswerStore(spark, scratch_path(spark, "answers"))
    assert store.answers().count() == 0
    schema = "digest string, response string, error string"
    store.commit(rows([("x", None, "E: down"), ("y", "2", None)], schema))
    store.commit(rows([("x", "1", None), ("y", "3", None)], schema))
    assert sorted(map(tuple, store.answers().collect())) == [("x", "1", None), ("y", "2", None)]
    assert store.finished().where(F.col("digest") == "x").count() == 1
