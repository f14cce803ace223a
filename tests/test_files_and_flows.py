import pytest
from pyspark.sql import functions as F

from loomset.operators.projection import SchemaError
from loomset.plans import exports, flows
from loomset.schema import INSTRUCTION_KIND, PREFERENCE_KIND, TEXT_KIND
from loomset.sinks import writers
from loomset.sources import formats, readers
from loomset.streaming import streams


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_detect_format(rows):
    names = {
        "a.csv": "csv", "A.JSONL": "jsonl", "x/b.json": "json", "b.csv/c.txt": "txt", "c.xlsx": "excel", "d.Pdf": "pdf",
        "e.zip": None, "plain": None,
    }
    for name, want in names.items():
        assert formats.detect_format(name) == want
    got = rows([(n,) for n in names], "p string").select("p", formats.format_of(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in got} == names


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'instruction,output,other\n"a ""q""\nb",NA,1\n,x,2\n')
    df, kind = readers.read_examples(spark, path)
    assert kind is INSTRUCTION_KIND
    assert sorted(map(tuple, df.collect()), key=str) == sorted([('a "q"\nb', "NA"), (None, "x")], key=str)
    df, _ = readers.read_examples(spark, path, null_token="nan")
    assert ("nan", "x") in set(map(tuple, df.collect()))


def test_csv_mapping(spark, tmp_path):
    path = write(tmp_path / "a.csv", "q,a,b\n1,2,3\n")
    with pytest.raises(SchemaError, match="map them"):
        readers.read_examples(spark, path)
    df, kind = readers.read_examples(spark, path, {"q": "prompt", "a": "chosen", "b": "rejected"}, preference=True)
    assert kind is PREFERENCE_KIND and tuple(df.first()) == ("1", "2", "3")


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text": "a"}\n\n  \n{"text": 3, "x": null}\n')
    df, kind = readers.read_examples(spark, path)
    assert kind is TEXT_KIND and sorted(r.text for r in df.collect()) == ["3", "a"]
    bad = write(tmp_path / "b.jsonl", '{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, bad, "text").collect()
    lenient = readers.read_jsonl(spark, bad, "text", strict=False).collect()
    assert sorted((r.text, r._corrupt_record) for r in lenient if r.text) == [("a", None)]
    assert [r._corrupt_record for r in lenient if not r.text] == ['{"text": ']


def test_json_array(spark, tmp_path):
    path = write(tmp_path / "a.json", '\n [ {"text": "a"},\n {"text": "b"} ]')
    assert sorted(r.text for r in readers.read_examples(spark, path)[0].collect()) == ["a", "b"]
    with pytest.raises(SchemaError, match="array"):
        readers.read_examples(spark, write(tmp_path / "b.json", '{"text": "a"}'))


def test_json_array_export_of_empty_partitions(spark):
    df = spark.range(3).selectExpr("id", "'t' AS text").repartition(8)
    got = readers.read_json_array(spark, exports.json_array_export(df), "id", "text")
    assert sorted(r.id for r in got.collect()) == ["0", "1", "2"]


def test_text_and_paragraphs(spark, tmp_path):
    path = write(tmp_path / "a.txt", " a \n\n \n b\r\nc\n")
    assert sorted(r.text for r in readers.read_text_lines(spark, path).collect()) == ["a", "b", "c"]
    path = write(tmp_path / "b.txt", "one\ntwo\n\n  \n\nthree \n\n")
    assert [r.text for r in readers.read_paragraphs(spark, path).orderBy("pos").collect()] == ["one\ntwo", "three"]


def test_unsupported(spark, tmp_path):
    for name in ("a.xlsx", "a.pdf", "a.zip"):
        with pytest.raises(formats.UnsupportedFormat):
            readers.read_examples(spark, str(tmp_path / name))


def test_prompts_and_eval(spark, tmp_path):
    with pytest.raises(SchemaError):
        readers.read_prompts(spark, write(tmp_path / "a.csv", "x\n1\n"))
    assert readers.read_prompts(spark, write(tmp_path / "b.csv", "prompt\nhi\n")).first().prompt == "hi"
    lines = readers.read_prompts(spark, write(tmp_path / "c.txt", " p1 \n\np2\n"))
    assert sorted(r.prompt for r in lines.collect()) == ["p1", "p2"]
    got = readers.read_eval(spark, write(tmp_path / "d.csv", "prompt\nhi\n")).first()
    assert (got.prompt, got.reference) == ("hi", None)
    with pytest.raises(SchemaError):
        readers.read_eval(spark, write(tmp_path / "e.csv", "reference\nhi\n"))
    with pytest.raises(formats.UnsupportedFormat):
        readers.read_eval(spark, write(tmp_path / "f.txt", "hi\n"))
    policy = readers.read_policy_prompts(spark, write(tmp_path / "g.csv", "prompt\nonly\n"))
    assert policy.first().prompt == "only"


def test_csv_round_trip_of_awkward_text(spark, rows, tmp_path):
    texts = ['a "b"', "x,\ny", " lead", "back\\slash\\", "😀", "tab\t"]
    writers.write_csv(rows([(t,) for t in texts], "prompt string"), str(tmp_path / "out.csv"))
    assert sorted(r.prompt for r in readers.read_csv(spark, str(tmp_path / "out.csv")).collect()) == sorted(texts)


def test_registry(spark, rows, tmp_path):
    registry = writers.DatasetRegistry(spark, str(tmp_path / "reg"))
    assert registry.list_versions().collect() == []
    data = rows([("a",), ("b",)], "text string")
    for version in ("1.10", "1.2"):
        meta = registry.publish(data, version, {"notes": "n"}).first()
    assert (meta.version, meta.notes, meta.base_model, meta.num_examples) == ("1.2", "n", "unknown", 2)
    assert [r.name for r in registry.list_versions().collect()] == ["metadata_v1.10.json", "metadata_v1.2.json"]
    assert registry.load("1.10").count() == 2
    with pytest.raises(ValueError):
        registry.publish(data, " ")
    with pytest.raises(ValueError, match="already exists"):
        registry.publish(data, "1.2")
    for odd in ("../x", "a/b", ".."):
        with pytest.raises(ValueError):
            registry.publish(data, odd)
    meta = registry.publish(data.limit(1), "2", {"licence": "own"}).first()
    assert meta.extra == {"licence": "own"} and registry.load("2").count() == 1


def test_registry_after_a_writer_that_died(spark, rows, tmp_path):
    registry = writers.DatasetRegistry(spark, str(tmp_path / "reg"))
    rows([("lost",)], "text string").write.parquet(f"{registry.root}/data/1.0-dead")
    registry.publish(rows([("a",), ("b",)], "text string"), "1.0")
    assert registry.load("1.0").count() == 2
    with pytest.raises(ValueError, match="does not exist"):
        registry.load("3")


def test_inspect_and_prepare(spark, tmp_path):
    lines = ["instruction,output"] + [f"do {i},done {i}" for i in range(20)] + [","]
    seen = flows.inspect(spark, write(tmp_path / "a.csv", "\n".join(lines)))
    assert {r.issue: r.n for r in seen.issues.collect()} == {"empty_removed": 1}
    assert seen.stats.first().num_examples == 20
    examples = flows.with_row_id(seen.examples, "instruction")
    out = str(tmp_path / "out")
    flows.prepare(examples, INSTRUCTION_KIND, "row_id", out, vocab_size=10, max_length=8)
    got = spark.read.parquet(f"{out}/examples")
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 2, "train": 18}
    assert {len(r.input_ids) for r in got.collect()} == {8}
    assert spark.read.parquet(f"{out}/vocab").count() == 12
    assert "- Examples: 20" in [r.value for r in spark.read.text(f"{out}/card").collect()]


def test_prepare_preferences(spark, rows, tmp_path):
    data = [(i, f"p{i}", f"good {i}", f"bad {i}") for i in range(10)] + [(99, "p", "", "r")]
    prefs = rows(data, "id int, prompt string, chosen string, rejected string")
    flows.prepare_preferences(prefs, "id", str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw" / "examples"))
    assert {r.split: r["count"] for r in raw.groupBy("split").count().collect()} == {"test": 1, "train": 9}
    assert set(raw.columns) == {"id", "prompt", "chosen", "rejected", "split"}
    flows.prepare_preferences(prefs, "id", str(tmp_path / "enc"), vocab_size=5, max_length=4)
    enc = spark.read.parquet(str(tmp_path / "enc" / "examples"))
    assert enc.count() == 10 and {len(r.input_ids_rejected) for r in enc.collect()} == {4}


def test_mapping_needed(spark, tmp_path):
    path = write(tmp_path / "a.csv", "question,answer\nq,a\n")
    assert flows.inspect(spark, path) == flows.MappingNeeded(["question", "answer"])
    seen = flows.inspect(spark, path, mapping={"question": "instruction", "answer": "output"})
    assert seen.kind is INSTRUCTION_KIND and seen.examples.count() == 1


def test_rewards_without_prompts(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"chosen": "good", "rejected": "bad"}\n{"chosen": "", "rejected": "bad"}\n')
    seen = flows.inspect(spark, path, preference=True, columns=("chosen", "rejected"))
    assert seen.kind.name == "reward" and seen.examples.count() == 1
    flows.prepare_preferences(flows.with_row_id(seen.examples, "chosen"), "row_id", str(tmp_path / "out"), vocab_size=5, max_length=4)
    assert spark.read.parquet(str(tmp_path / "out" / "examples")).first().input_ids_chosen == [3, 0, 0, 0]


def test_prepare_with_filter_and_copies(spark, rows, tmp_path):
    texts = rows([(i, f"word{i} some more words") for i in range(20)] + [(50, "tiny")], "id int, text string")
    out = str(tmp_path / "out")
    report = flows.prepare(
        texts, TEXT_KIND, "id", out, 10, 8, lengths=(10, 100), augmenting={"factor": 3, "method": "random_word"}
    )
    assert tuple(report.first()) == (21, 1, 20)
    got = spark.read.parquet(f"{out}/examples")
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 6, "train": 54}
    assert got.groupBy("id").agg({"split": "max"}).count() == 20


def test_preview_of_nothing(spark, tmp_path):
    seen = flows.inspect(spark, write(tmp_path / "a.csv", "text\n"))
    assert seen.preview("text").columns == ["Status"]


def test_answer_and_evaluate_files(spark, tmp_path):
    load = lambda: None

    def echo(model, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    out = flows.answer_file(spark, write(tmp_path / "p.txt", "one\nbad\n"), str(tmp_path / "o.csv"), load, echo)
    assert {r.prompt: r.response for r in out.collect()} == {"one": "ONE", "bad": "RuntimeError: no"}
    path = write(tmp_path / "e.csv", "prompt,reference\none,one\ntwo,three\n")
    report, table = flows.evaluate_file(spark, path, load, echo, judge_with=(load, lambda m, ps: ["7"] * len(ps)))
    assert {r.metric: r.value for r in report.collect()}["ROUGE-1"] == 0.5
    assert sorted((r.prompt, r.prediction, r.reference, r.judgment) for r in table.collect()) == [
        ("one", "ONE", "one", "7"), ("two", "TWO", "three", "7"),
    ]
    embed = lambda model, text: [[1.0, 0.0] if w.lower() == "one" else [0.0, 1.0] for w in text.split()]
    report, _ = flows.evaluate_file(spark, path, load, echo, embed_with=(load, embed))
    values = {r.metric: r.value for r in report.collect()}
    assert len(values) == 7 and values["BERTScore-F1"] == 1.0
    report, table = flows.evaluate_file(spark, write(tmp_path / "n.csv", "prompt\none\n"), load, echo)
    assert report is None and table.columns == ["row_id", "prompt", "prediction"]


def test_stream_equals_batch(spark, rows, tmp_path):
    data = rows([("x" * n, "y") for n in (0, 10, 60, 3000, 9000)], "instruction string, output string")
    data.repartition(3).write.json(str(tmp_path / "in"))
    stream = streams.stream_jsonl(spark, str(tmp_path / "in"), "instruction", "output")
    args = (INSTRUCTION_KIND, "output")
    streams.run_available(
        streams.clean_and_format(stream, *args, template="chatml"), str(tmp_path / "out"), str(tmp_path / "state")
    )
    batch = streams.clean_and_format(data, *args, template="chatml")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_csv_and_text_streams(spark, tmp_path):
    (tmp_path / "csv").mkdir(), (tmp_path / "txt").mkdir()
    write(tmp_path / "csv" / "a.csv", 'text\n"a\nb"\nc\n')
    write(tmp_path / "txt" / "a.txt", " x \n\ny\n")
    for name, stream in (("csv", streams.stream_csv(spark, str(tmp_path / "csv"), "text")), ("txt", streams.stream_text_lines(spark, str(tmp_path / "txt")))):
        streams.run_available(stream, str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}"))
    read = lambda name: sorted(r.text for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect())
    assert read("csv") == ["a\nb", "c"] and read("txt") == ["x", "y"]


def test_late_losses_are_dropped(spark, tmp_path):
    schema = "run_id long, ts timestamp, train_loss double"
    put = lambda *r: spark.createDataFrame(list(r), "run_id long, ts string, train_loss double").selectExpr(
        "run_id", "cast(ts AS timestamp) AS ts", "train_loss"
    ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streams.run_available(
        streams.loss_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    put((1, "2024-01-01 00:05:00", 1.0), (1, "2024-01-01 00:50:00", 2.0), (1, "2024-01-01 03:00:00", 9.0))
    run()
    put((1, "2024-01-01 00:55:00", 100.0), (1, "2024-01-01 05:00:00", 1.0))
    run()
    got = sorted((str(r.window_start), r.n, r.train_loss) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 00:00:00", 2, 1.5), ("2024-01-01 03:00:00", 1, 9.0)]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("instruction,output\nask,answer\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "output", "instruction").first()
    assert (got.output, got.instruction) == ("answer", "ask")
    with pytest.raises(SchemaError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "prompt")
    (tmp_path / "b.csv").write_text("output,instruction\nanswer,ask\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path), "output", "instruction").collect()
