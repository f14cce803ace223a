import csv
import json
import random
from collections import Counter

import pytest
from loomset.operators.projection import SchemaError
from loomset.sources import ranges, readers
from pyspark.errors import PySparkException


@pytest.fixture
def cut(spark):
    """Files are cut into ranges of the given size while the test runs."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield of
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def cell(rng):
    made = "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", "\\", "}", "{", " ", "日", "x" * 40]) for _ in range(rng.randrange(0, 25)))
    return made if made.strip() else f"v{rng.randrange(100)}"


def table(seed, n):
    rng = random.Random(seed)
    return [(str(i), cell(rng), cell(rng) * (60 if i % 20 == 7 else 1)) for i in range(n)]


def write_csv(path, header, rows, end="\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_MINIMAL, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_csv_ranges_equal_whole_files(spark, tmp_path, cut, size):
    rows = table(1, 60)
    write_csv(tmp_path / "one.csv", ["id", "first", "second"], rows)
    cut(size)
    got = ranges.read_csv_ranges(spark, str(tmp_path / "one.csv"))
    assert got.columns == ["id", "first", "second"]
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    if size == 500:
        assert spark.read.text(str(tmp_path / "one.csv"), lineSep="\n").rdd.getNumPartitions() > 8
    picked = ranges.read_csv_ranges(spark, str(tmp_path / "one.csv"), "second", "id").collect()
    assert Counter(map(tuple, picked)) == Counter((c, a) for a, _, c in rows)
    cut(128 << 20)
    whole = readers.read_csv(spark, str(tmp_path / "one.csv"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole.collect()))


def test_csv_ranges_of_a_folder_go_by_each_header(spark, tmp_path, cut):
    rows = table(2, 45)
    write_csv(tmp_path / "a.csv", ["id", "first", "second"], rows[:15])
    write_csv(tmp_path / "b.csv", ["second", "id", "first"], [(c, a, b) for a, b, c in rows[15:30]], "\r\n")
    write_csv(tmp_path / "c.csv", ["first", "id"], [(b, a) for a, b, _ in rows[30:]])
    write_csv(tmp_path / "d.csv", ["id", "first"], [])
    cut(700)
    got = ranges.read_csv_ranges(spark, str(tmp_path), "id", "first", "second").collect()
    assert Counter(map(tuple, got)) == Counter(rows[:30] + [(a, b, None) for a, b, _ in rows[30:]])
    with pytest.raises(SchemaError):
        ranges.read_csv_ranges(spark, str(tmp_path), "third")


def test_csv_ranges_awkward_files(spark, tmp_path, cut):
    (tmp_path / "x.csv").write_text('a,"b\nc"\n\n1,"x\n\ny"\n"",\n2,"say ""hi"""', newline="")
    cut(20)
    got = ranges.read_csv_ranges(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b\nc"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, readers.read_csv(spark, str(tmp_path / "x.csv")).collect()))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert ranges.read_csv_ranges(spark, str(tmp_path / "head.csv")).collect() == []


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [900])
def test_array_ranges_equal_whole_files(spark, tmp_path, cut, size, indent):
    rows = [{"id": a, "first": b, "second": c, "deep": {"list": [{"x": b}, "}", '"', "\\"], "n": 1}} for a, b, c in table(3, 40)]
    (tmp_path / "one.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent) + "\n")
    (tmp_path / "none.json").write_text("[]")
    cut(size)
    got = ranges.read_json_array_ranges(spark, str(tmp_path), "id", "second", "first").collect()
    assert Counter(map(tuple, got)) == Counter((r["id"], r["second"], r["first"]) for r in rows)
    named = ranges.read_json_array_ranges(spark, str(tmp_path))
    assert named.columns == ["deep", "first", "id", "second"]
    assert Counter(json.dumps(json.loads(r.deep)) for r in named.collect()) == Counter(json.dumps(r["deep"]) for r in rows)
    elements = [r.element for r in ranges.json_elements(spark, str(tmp_path)).collect()]
    assert Counter(json.dumps(json.loads(e)) for e in elements) == Counter(json.dumps(r) for r in rows)


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1} 5]', '[[{"a": 1}]]', '[{"a": 1}, {"b": 2}', '[{"a": 1}, "}"]'])
def test_other_json_is_an_error(spark, tmp_path, cut, text):
    (tmp_path / "bad.json").write_text(text)
    cut(10)
    with pytest.raises(PySparkException):
        ranges.read_json_array_ranges(spark, str(tmp_path / "bad.json"), "a").collect()
