import sys

from pyspark import cloudpickle

from loomset.operators import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    return "model"


def test_batches_and_loader(spark):
    def score(model, prompts):
        return [f"{model}:{p}:{len(prompts)}" for p in prompts]

    df = spark.range(20).selectExpr("id", "cast(id AS string) AS prompt").coalesce(1)
    got = scoring.batch_score(df, load, score).collect()
    sizes = [int(r.response.rsplit(":", 1)[1]) for r in got]
    assert sorted(sizes) == [4] * 4 + [8] * 16
    assert all(r.response.startswith(f"model:{r.prompt}:") and r.error is None for r in got)


def test_only_failing_rows_carry_errors(spark):
    def score(model, prompts):
        return [str(10 // int(p)) for p in prompts]

    df = spark.range(10).selectExpr("cast(id AS string) AS prompt")
    got = {r.prompt: (r.response, r.error) for r in scoring.batch_score(df, load, score).collect()}
    assert len(got) == 10
    assert got["0"][0] is None and got["0"][1].startswith("ZeroDivisionError")
    assert got["5"] == ("2", None)


def test_wrong_number_of_answers_is_not_trusted(spark):
    df = spark.range(3).selectExpr("cast(id AS string) AS prompt")
    got = scoring.batch_score(df, load, lambda m, p: p[:1]).collect()
    assert all(r.response == r.prompt for r in got)


def test_one_model_stays_resident():
    calls = []
    make = lambda name: lambda: calls.append(name) or name
    scoring._resident.clear()
    for name in ("a", "a", "b", "b", "a"):
        assert scoring.resident(name, make(name)) == name
    assert calls == ["a", "b", "a"] and len(scoring._resident) == 1


def test_calls_do_not_share_models_unless_keyed(spark):
    df = spark.range(4).selectExpr("cast(id AS string) AS prompt").coalesce(1)
    answer = lambda model, prompts: [model] * len(prompts)
    ask = lambda name, **key: {r.response for r in scoring.batch_score(df, lambda: name, answer, **key).collect()}
    assert ask("a") == {"a"} and ask("b") == {"b"}
    assert ask("c", model_key="k") == {"c"} and ask("d", model_key="other") == {"d"}


def test_judge_cuts_strips_and_keeps_all_criteria(rows):
    df = rows([(1, "p", "w " * 3000)], "id int, prompt string, response string")
    got = scoring.judge(df, "id", load, lambda m, ps: [f" {len(p.split())} " for p in ps]).collect()
    assert len(got) == 5
    assert {r.judgment for r in got} == {"1024"}
