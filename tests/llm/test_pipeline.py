"""run() against brute force, stage by stage."""

from collections import Counter

import corpora
import corpus_pipeline
import test_near_dups
import test_rules_and_mixing as rules
import test_scans
import test_tokens_and_packing as tokens


def documents():
    rows = [(i, t, s) for i, t, s in corpora.documents(12) if s != "long"]
    return rows + [(8000 + i, f"{corpora.prose(corpora.random.Random(i), 80)} write to user{i}@mail.example.org or +1 (743) 555-38{i:02d} ok", "src1") for i in range(6)]


def test_stages_and_run_equal_brute_force(spark, rows, tmp_path):
    data = documents()
    docs = corpora.frame(rows, data)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    outs, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        outs[name] = at = spark.read.parquet(str(tmp_path / name))
    got = {n: [(r.doc_id, r.text, r.source) for r in d.collect()] for n, d in outs.items() if n != "packing"}

    assert Counter(got["quality_rules"]) == Counter(r for r in data if not rules.base_failed(rules.measures(r[1])))
    judged = test_near_dups.brute_force(got["quality_rules"], 5)
    assert {i for i, _, _ in got["near_duplicates"] if i is not None} == {i for i, _, _, kept in judged if kept and i is not None}
    assert set(got["near_duplicates"]) <= set(got["quality_rules"])

    masked = Counter()
    for i, t, s in got["near_duplicates"]:
        for kind, a, b in sorted(test_scans.private_of(t), key=lambda x: -x[1]):
            t = f"{t[:a]}[{('EMAIL', 'IP', 'CARD', 'PHONE')[kind]}]{t[b:]}"
        masked[i, t, s] += 1
    assert Counter(got["personal_data"]) == masked

    size = Counter()
    for _, t, s in got["personal_data"]:
        size[s] += rules.measures(t)[0]
    taken = Counter()
    for _, t, s in got["mixing"]:
        taken[s] += rules.measures(t)[0]
    largest = max(rules.measures(t)[0] for _, t, _ in got["personal_data"])
    assert all(abs(taken[s] - target) <= largest for s, target in rules.water(dict(size)).items())
    assert set(got["mixing"]) <= set(got["personal_data"]) and max(Counter(got["mixing"]).values()) <= 3

    tokens.check_packing([(i, t) for i, t, _ in got["mixing"]], outs["packing"].collect(), 2048)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, outs["packing"].select(*columns).collect()))


def test_empty_table(spark, rows, tmp_path):
    corpora.frame(rows, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
