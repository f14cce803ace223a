import math
import random
from collections import Counter

import numpy as np
import pytest

from loomset.functions.overlap import lcs_length, shared_ngrams
from loomset.functions.stem import stem
from loomset.operators import embedding, metrics

# Published examples of the stemmer's rules.
STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controlling control rolling roll dying die news news skies sky""".split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, want):
    assert stem(word) == want


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def brute_bleu(pred, ref):
    p, r = pred.split(), ref.split()
    if not p:
        return None
    total, i, logs = 0, 1, []
    for n in range(1, 5):
        hits = sum((grams(p, n) & grams(r, n)).values())
        if n == 1 and hits == 0:
            return 0.0
        size = max(1, len(p) - n + 1)
        if hits == 0 and len(p) > 1:
            logs.append(0.25 * math.log(math.log(len(p)) / (2**i * 5) / size))
            i += 1
        elif hits:
            logs.append(0.25 * math.log(hits / size))
    brevity = 1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p))
    return brevity * math.exp(sum(logs))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(70))] for _ in range(2))
        assert lcs_length(a, b) == brute_lcs(a, b)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(2)
    words = [chr(97 + i) * 2 for i in range(8)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    data = [(i, text(rng.randrange(12)), text(rng.randrange(12))) for i in range(60)]
    same = " ".join(words)
    return data + [(100, same, same), (101, "xx", "yy"), (102, "", ""), (103, "aa", "aa"), (104, "aa " * 500, "aa bb " * 300)]


@pytest.mark.parametrize("parts", [1, 13])
def test_scores_against_brute_force(spark, pairs, parts):
    df = spark.createDataFrame(pairs, "id int, prediction string, reference string").repartition(parts)
    got = {r.id: r for r in metrics.score_rows(df, "id", stem=False).collect()}
    assert len(got) == len(pairs)
    for i, pred, ref in pairs:
        want = brute_bleu(pred, ref)
        assert got[i].bleu == (None if want is None else pytest.approx(want))
        p, r = pred.split(), ref.split()
        for n, name in ((1, "rouge1"), (2, "rouge2")):
            hits = sum((grams(p, n) & grams(r, n)).values())
            denominator = max(len(p) - n + 1, 0) + max(len(r) - n + 1, 0)
            assert got[i][name] == pytest.approx(2 * hits / denominator if hits else 0.0)
        common = brute_lcs(p, r)
        assert got[i].rougeL == pytest.approx(2 * common / (len(p) + len(r)) if common else 0.0)
    assert (got[100].bleu, got[100].rouge1, got[100].rougeL) == (pytest.approx(1),) * 3
    assert (got[101].bleu, got[101].rouge1, got[101].rougeL) == (0, 0, 0)


def test_stemming_matches_inflections(rows):
    df = rows([(1, "Cats running!", "cat run")], "id int, prediction string, reference string")
    assert metrics.score_rows(df, "id").first().rouge1 == 1.0
    assert metrics.score_rows(df, "id", stem=False).first().rouge1 == 0.0


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_ngrams_do_not_shuffle(rows):
    df = rows([(1, "a b", "a b")], "id int, prediction string, reference string")
    assert "Exchange" not in _final_plan(metrics.score_rows(df, "id"))
    assert _final_plan(metrics.ngram_overlap(df, "id")).count("Exchange hashpartitioning") == 1


def test_grouped_counts_agree_with_counts_per_row(spark, pairs):
    df = spark.createDataFrame(pairs, "id int, prediction string, reference string")
    grouped = {(r.id, r.n): (r.clipped, r.pred_total, r.ref_total) for r in metrics.ngram_overlap(df, "id").collect()}
    assert len(grouped) == 4 * len(pairs)
    for i, pred, ref in pairs:
        p, r = pred.split(), ref.split()
        for n in range(1, 5):
            assert grouped[i, n] == (shared_ngrams(p, r, n), max(len(p) - n + 1, 0), max(len(r) - n + 1, 0))


def test_report(rows):
    df = rows([(1, "a b", "a b"), (2, "", "a")], "id int, prediction string, reference string")
    got = {r.metric: r.value for r in metrics.evaluate(df, "id").collect()}
    assert got["ROUGE-1"] == 0.5
    assert got["BLEU-1"] == round(brute_bleu("a b", "a b"), 4)
    assert metrics.evaluate(df.drop("reference"), "id") is None


def test_results_keep_rows_with_a_prediction(rows):
    prompts = rows([(1, "p"), (2, "q")], "id int, prompt string")
    predictions = rows([(1, "x")], "id int, prediction string")
    judged = rows([(2, "7")], "id int, judgment string")
    out = metrics.assemble_results(prompts, predictions, "id", judgments=judged)
    assert out.columns == ["id", "prompt", "prediction", "judgment"]
    assert [tuple(r) for r in out.collect()] == [(1, "p", "x", None)]


@pytest.mark.parametrize("block,chunk", [(256, 16), (4, 2), (1, 1)])
def test_embedding_match_in_any_blocks(spark, block, chunk):
    rng = np.random.default_rng(3)
    sizes = {1: (40, 9), 2: (1, 1), 3: (5, 30)}  # one pair holds most of the rows
    data, want = [], {}
    for pair, (n, m) in sizes.items():
        x, y = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
        data += [(pair, "pred", i, v.tolist()) for i, v in enumerate(x)]
        data += [(pair, "ref", i, v.tolist()) for i, v in enumerate(y)]
        cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        p, r = cos.max(axis=1).mean(), cos.max(axis=0).mean()
        want[pair] = (p, r, 2 * p * r / (p + r))
    df = spark.createDataFrame(data, "pair_id int, side string, pos int, vec array<double>")
    got = {m.pair_id: (m.p, m.r, m.f1) for m in embedding.embedding_match(df, block, chunk).collect()}
    assert set(got) == set(want)
    for pair in want:
        assert got[pair] == pytest.approx(want[pair])


def test_embedding_report_of_nothing(spark):
    none = spark.createDataFrame([], "pair_id int, side string, pos int, vec array<double>")
    report = embedding.match_report(embedding.embedding_match(none))
    assert {r.metric: r.value for r in report.collect()} == {"BERTScore-P": 0.0, "BERTScore-R": 0.0, "BERTScore-F1": 0.0}


def test_rows_of_one_task_are_dealt_out(rows):
    df = rows([(i, f"a b {i}", "a b") for i in range(200)], "id int, prediction string, reference string").coalesce(1)
    scored = metrics.score_rows(df, "id", deal=True)
    assert scored.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, metrics.score_rows(df, "id").collect()))
