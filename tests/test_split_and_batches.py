import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomset.operators import batching, split


def brute_test_set(ids, fraction=0.1, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i))
    return set(order[: math.ceil(fraction * len(ids))])


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 500])
def test_exact_sizes_and_members(spark, n):
    df = spark.range(n).repartition(5)
    got = {r.id: r.split for r in split.with_split(df, "id").collect()}
    assert {i for i, s in got.items() if s == "test"} == brute_test_set(range(n))
    assert len(got) == n


def test_partitioning_does_not_matter_and_halves_are_disjoint(spark):
    base = spark.range(1000)
    a, b = (split.with_split(base.repartition(k), "id") for k in (1, 13))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    train, test = split.train_test_split(base, "id")
    assert train.join(test, "id").count() == 0
    assert train.union(test).distinct().count() == 1000


def test_rows_are_labelled_in_place(spark):
    plan = split.with_split(spark.range(100), "id")._jdf.queryExecution().optimizedPlan().toString()
    head = plan.splitlines()[0]
    assert head.startswith("Project")


@pytest.mark.parametrize("n,size", [(0, 8), (1, 8), (8, 8), (9, 8), (100, 7)])
def test_batches(spark, n, size):
    df = spark.range(n).select((F.col("id") * 3).alias("k")).repartition(6)
    got = sorted(tuple(r) for r in batching.assign_batches(df, "k", size=size).collect())
    assert got == [(3 * i, i // size) for i in range(n)]


def test_reported_batches():
    assert [batching.reported_batches(n, 8) for n in (0, 7, 8, 17)] == [1, 1, 1, 2]


def test_pair_numbers_of_very_long_chats(rows):
    from loomset.plans.fixtures import pair_id

    data = [(1, 999), (1, 1000), (1, 70_000), (2, 0), (2, 1)]
    got = rows(data, "c long, t long").select(pair_id(F.col("c"), F.col("t")).alias("k"))
    assert got.distinct().count() == 5
    with pytest.raises(Exception, match="out of range"):
        rows([(1, 1 << 40)], "c long, t long").select(pair_id(F.col("c"), F.col("t"))).collect()


def test_vocabulary_ranked_by_ranges(rows, monkeypatch):
    from loomset.operators import encode

    texts = rows([(i, f"w{i % 7} w{i % 3} common") for i in range(50)], "id int, text string")
    want = sorted(map(tuple, encode.build_vocab(texts, "text", size=5).collect()))
    monkeypatch.setattr(encode, "BROADCAST_WORDS", 2)
    assert sorted(map(tuple, encode.build_vocab(texts, "text", size=5).collect())) == want
