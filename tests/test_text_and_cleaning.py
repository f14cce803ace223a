from loomset.functions.text import alnum_text, example_length, first_tokens, strip, tokens
from loomset.operators import clean, preview, projection, stats
from loomset.schema import INSTRUCTION_KIND, PREFERENCE_KIND, TEXT_KIND
import pytest
from pyspark.sql import functions as F

SAMPLES = [
    "", " \t\n", "a", " a  b ", " x y　", "x\x1cy\x85z", "😀é é", "one\r\ntwo three", "a​b",
]


def test_strip_and_tokens_follow_unicode_white_space(rows):
    df = rows([(i, s) for i, s in enumerate(SAMPLES)] + [(99, None)], "id int, s string")
    got = {r["id"]: r for r in df.select("id", strip("s").alias("t"), tokens("s").alias("w")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i]["t"] == s.strip()
        assert got[i]["w"] == s.split()
    assert got[99]["w"] == []


def test_alnum_text(rows):
    df = rows([("Don't STOP-it: 3.5!",), ("",), ("é",)], "s string")
    assert [r[0].split() for r in df.select(alnum_text("s")).collect()] == [["don", "t", "stop", "it", "3", "5"], [], []]


def test_first_tokens(rows):
    texts = {"a b  c d": "a b  c", "a\n\nb  c": "a\n\nb  c", " \u00a0a\tb c d": " \u00a0a\tb c", "a b c ": "a b c ", "": ""}
    got = rows([(t,) for t in texts], "s string").select("s", first_tokens("s", 3).alias("cut")).collect()
    assert {r.s: r.cut for r in got} == texts


def test_lengths_count_code_points_and_null_as_empty(rows):
    df = rows([("😀é", None)], "instruction string, output string")
    assert df.select(example_length(INSTRUCTION_KIND)).first()[0] == 2


def test_drop_empty(rows):
    text = rows([(1, ""), (2, None), (3, "x")], "id int, text string")
    assert [r.id for r in clean.drop_empty(text, TEXT_KIND).collect()] == [3]
    pairs = rows([(1, "", ""), (2, "", "x"), (3, None, None)], "id int, instruction string, output string")
    assert [r.id for r in clean.drop_empty(pairs, INSTRUCTION_KIND).collect()] == [2]


def test_drop_empty_preference_gate(rows):
    schema = "id int, prompt string, chosen string, rejected string"
    partial = [(1, "p", "", "r"), (2, "p", "c", "r")]
    with_blank = partial + [(3, "", "", "")]
    ids = lambda data, **o: sorted(r.id for r in clean.drop_empty(rows(data, schema), PREFERENCE_KIND, **o).collect())
    assert ids(partial) == [2]
    assert ids(partial, compat=True) == [1, 2]
    assert ids(with_blank, compat=True) == [2]


def test_quality_bounds_are_inclusive(rows):
    df = rows([(n, "x" * n) for n in (49, 50, 2048, 2049)], "id int, text string")
    assert sorted(r.id for r in clean.quality_filter(df, TEXT_KIND).collect()) == [50, 2048]
    pairs = rows([(n, "x" * (n - 1), "y") for n in (49, 50, 4096, 4097)], "id int, instruction string, output string")
    assert sorted(r.id for r in clean.quality_filter(pairs, INSTRUCTION_KIND).collect()) == [50, 4096]
    prefs = rows([(1, "p" * 50, "c" * 50, ""), (2, "p" * 50, "c", "r" * 50)], "id int, prompt string, chosen string, rejected string")
    assert [r.id for r in clean.quality_filter(prefs, PREFERENCE_KIND).collect()] == [1]


def test_reports(rows):
    df = rows([("",), (None,), ("x" * 2048,), ("x" * 2049,)], "text string")
    assert {r.issue: r.n for r in clean.validation_report(df, TEXT_KIND).collect()} == {"empty_removed": 2, "over_length": 1}
    assert {r.issue: r.n for r in clean.validation_report(df.limit(0), TEXT_KIND).collect()} == {"empty_after_cleaning": 0}
    assert clean.validation_report(df, None).collect()[0].issue == "unknown_structure"
    q = clean.quality_report(df, TEXT_KIND).first()
    assert (q.original, q.removed, q.remaining) == (4, 3, 1)


def test_compat_report_counts_rows_empty_in_all_fields(rows):
    prefs = rows([("p", "", "r"), ("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert {r.issue: r.n for r in clean.validation_report(prefs, PREFERENCE_KIND).collect()} == {"empty_removed": 1}
    assert clean.validation_report(prefs, PREFERENCE_KIND, compat=True).collect() == []


def test_stats_of_nothing(rows):
    empty = rows([], "text string")
    assert stats.dataset_stats(empty, TEXT_KIND).first().avg_length == 0.0
    assert stats.length_stats(empty, TEXT_KIND).first().num_examples == 0


def test_kinds():
    kind = projection.resolve_kind
    assert kind(["instruction", "output", "text"]) is INSTRUCTION_KIND
    assert kind(["text", "output"]) is TEXT_KIND
    assert kind(["prompt", "chosen", "rejected"]) is None
    assert kind(["prompt", "chosen", "rejected"], preference=True) is PREFERENCE_KIND
    assert kind(["text"], preference=True) is None
    with pytest.raises(projection.SchemaError, match="found"):
        projection.require_kind(["a"])


def test_mapping():
    m = projection.build_mapping
    assert m("a", "b", "c") == {"a": "instruction", "b": "output"}
    assert m("a", None, "c") == {"c": "text"}
    assert m(None, None, None) == {}
    assert m("a", "b", None, preference=True) == {}
    assert m("a", "b", "c", preference=True) == {"a": "prompt", "b": "chosen", "c": "rejected"}


def test_prompt_column(rows):
    assert projection.resolve_prompt(rows([("t", "i")], "text string, instruction string")).columns == ["prompt", "instruction"]
    assert projection.resolve_prompt(rows([("i",)], "instruction string")).columns == ["prompt"]
    with pytest.raises(projection.SchemaError):
        projection.resolve_prompt(rows([("i",)], "other string"))


def test_stringify_null_token(rows):
    df = rows([(1, 2, None)], "id int, instruction int, output double")
    assert tuple(projection.stringify(df, INSTRUCTION_KIND, "id").first()) == (1, "2", None)
    assert tuple(projection.stringify(df, INSTRUCTION_KIND, null_token="nan").first()) == ("2", "nan")


def test_previews(rows):
    df = rows([(i, f"i{i}", f"o{i}") for i in range(9)], "id int, instruction string, output string")
    assert [r.id for r in preview.preview(df, INSTRUCTION_KIND, "id").collect()] == [0, 1, 2, 3, 4]
    shown = preview.preview_formatted(df, INSTRUCTION_KIND, "id")
    assert shown.first().preview == "**Instruction:** i0\n**Output:** o0"
    assert preview.joined_preview(shown, "id").first()[0].count("\n\n---\n\n") == 4
