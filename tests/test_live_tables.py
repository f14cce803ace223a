import math
import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from loomset.operators.losses import early_stop_step
from loomset.runtime import scratch_path
from loomset.sinks.writers import DatasetRegistry, create_new
from loomset.streaming import stopping, streams, upserts

LOGS = "run_id bigint, step bigint, train_loss double, eval_loss double, ts timestamp"
START = datetime(2024, 1, 1)


def slices(spark, folder, parts, schema=LOGS):
    """One file per part, which a stream takes one after another."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9:
                os.utime(path, (1e6 + i, 1e6 + i))


def logs(seed, n=1200):
    rng = random.Random(seed)
    rows = []
    for step in range(n):
        run = rng.choice([None, *range(30)])
        loss = rng.choice([None, math.nan, rng.random(), 5 - step / n, 1.0])
        rows.append((run, step, rng.random(), loss, START + timedelta(minutes=step)))
    return rows


def drained(spark, stream, name):
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    streams.run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize("patience", [1, 3])
def test_stops_on_a_stream_are_those_of_the_table(spark, rows, patience):
    data = logs(patience)
    want = {tuple(r) for r in early_stop_step(rows(data, LOGS), patience).collect()}
    assert want
    late = sorted(data, key=lambda r: (r[1] // 5, -r[1]))  # steps come up to four minutes late
    folder = scratch_path(spark, "logs")
    closing = [tuple(r) for r in stopping.closing(rows(data, LOGS)).collect()]
    slices(spark, folder, [late[:400], late[400:900], late[900:], closing])
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(folder)
    got = [tuple(r) for r in drained(spark, stopping.early_stops(stream, patience), "stops").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_stop_without_patience_or_for_absent_losses(spark, rows):
    data = [(1, s, None, loss, START + timedelta(minutes=s)) for s, loss in enumerate([5.0, math.nan, math.nan, math.nan, 4.0, 3.0])]
    assert early_stop_step(rows(data, LOGS)).collect() == []
    folder = scratch_path(spark, "logs")
    slices(spark, folder, [data, [tuple(r) for r in stopping.closing(rows(data, LOGS)).collect()]])
    stream = lambda: spark.readStream.schema(LOGS).parquet(folder)
    assert drained(spark, stopping.early_stops(stream()), "stops").count() == 0
    assert drained(spark, stopping.early_stops(stream(), 0), "none").count() == 0


def test_nan_is_no_part_of_a_window(spark):
    folder = scratch_path(spark, "logs")
    slices(spark, folder, [[(1, s, math.nan if s == 2 else 1.0, None, START + timedelta(minutes=s)) for s in range(6)]])
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "windows-state")
    stream = streams.loss_windows(spark.readStream.schema(LOGS).parquet(folder))
    streams.run_to_end(stream, out, state)
    assert [(r.n, r.train_loss) for r in spark.read.parquet(out).collect()] == [(5, 1.0)]


def test_upserts_by_key_and_replayed_batches(spark, rows):
    schema = "day string, k int, v int"
    table = upserts.UpsertTable(spark, scratch_path(spark, "table"), rows([], schema).schema, ["k"], "day")
    now = lambda before=None: sorted(map(tuple, table.read(before).collect()))
    assert now() == []
    first, second = [("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], [("a", 2, 21), ("c", 4, 40)]
    table.upsert(rows(first, schema), 0)
    for _ in range(3):  # the second batch is replayed
        table.upsert(rows(second, schema), 1)
        assert now() == [("a", 1, 10), ("a", 2, 21), ("b", 3, 30), ("c", 4, 40)]
    touched = {name for name in os.listdir(f"{table.path}/data/_batch=1") if name.startswith("day=")}
    assert touched == {"day=a", "day=c"}  # the partition b is left alone
    table.upsert(rows([], schema), 2)
    assert len(now()) == 4 and now(1) == sorted(first)
    # A writer that died before it listed its partitions has changed nothing.
    rows([("a", 9, 9)], schema).write.partitionBy("day").parquet(f"{table.path}/data/_batch=3")
    assert len(now()) == 4


def test_chart_counts_a_step_once_and_follows_corrections(spark, rows):
    folder = scratch_path(spark, "logs")
    record = lambda step, minute, loss: (1, step, loss, None, START + timedelta(minutes=minute))
    slices(spark, folder, [[record(0, 0, 1.0), record(1, 1, 3.0), record(1, 1, 3.0)], [record(0, 5, 1.0), record(2, 2, 5.0)], [record(3, 70, 7.0)]])
    chart = streams.loss_chart(spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(folder))
    table = upserts.UpsertTable(spark, scratch_path(spark, "chart"), chart.schema, ["run_id", "window_start"], "day")
    upserts.run_upserts(chart, table, scratch_path(spark, "chart-state"))
    assert [(r.window_start.hour, r.n, r.train_loss) for r in table.read().orderBy("window_start").collect()] == [(0, 3, 3.0), (1, 1, 7.0)]


def test_one_of_two_publishers_gets_the_version(spark, rows):
    registry = DatasetRegistry(spark, scratch_path(spark, "registry"))
    outcomes, ready = [], threading.Barrier(2)

    def publish(n):
        frame = rows([(i,) for i in range(n)], "x int")
        check, calls = registry._check_free, []

        def together(version):  # both have seen the version free before either commits
            check(version)
            calls.append(version)
            if len(calls) == 1:
                ready.wait(60)

        mine = DatasetRegistry(spark, registry.root)
        mine._check_free = together
        try:
            mine.publish(frame, "1.0")
            outcomes.append(n)
        except ValueError as e:
            outcomes.append(str(e))

    threads = [threading.Thread(target=publish, args=(n,)) for n in (3, 4)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    won = [o for o in outcomes if isinstance(o, int)]
    assert len(won) == 1 and "version 1.0 already exists" in outcomes
    assert registry.load("1.0").count() == won[0]
    assert registry.list_versions().count() == 1


def test_log_is_replayed(spark, rows):
    registry = DatasetRegistry(spark, scratch_path(spark, "registry"))
    registry.publish(rows([(1,)], "x int"), "1.0", {"licence": "own", "notes": "n"})
    registry.withdraw("1.0")
    assert registry.list_versions().collect() == []
    for call in (registry.load, registry.withdraw):
        with pytest.raises(ValueError):
            call("1.0")
    again = registry.publish(rows([(1,), (2,)], "x int"), "1.0").first()
    assert again.num_examples == 2 and registry.load("1.0").count() == 2
    path = f"{registry.root}/log/x.json"
    assert create_new(spark, path, "{}") and not create_new(spark, path, "[]")
