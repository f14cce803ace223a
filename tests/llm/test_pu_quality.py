import random
import zlib

import corpora
import numpy as np
import pytest
from loomset.llm import pu_quality as pq
from pyspark.sql import functions as F

LABELS = "doc_id bigint, quality int, toxic int, text string, trusted string"


def spoiled(rng, text):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split())
    if kind == 1:
        return " | ".join(text.split())
    return " ".join([text.split()[0]] * 80)


def corpus(seed=1, n=900, bad=0.25):
    rng = random.Random(seed)
    docs, quality = [], {}
    for i in range(n):
        text = corpora.prose(rng, rng.randrange(30, 200))
        quality[i] = int(rng.random() >= bad)
        docs.append((i, text if quality[i] else spoiled(rng, text), f"src{i % 3}"))
    labels = [(i, q, 0, "clash", "clash") for i, q in quality.items() if rng.random() < 0.4]
    return docs, quality, labels


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    label = np.array(label)
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_quality_from_positives_alone(rows):
    docs, quality, labels = corpus()
    awkward = [d for d in corpora.documents(3) if d[0] is None or d[0] >= 3000]
    awkward = [(None if i is None else i + 10_000, t, s) for i, t, s in awkward]
    out = pq.classify(corpora.frame(rows, docs + awkward), rows(labels + [(None, 1, 0, "", ""), (5, None, 0, "", "")], LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs) + len(awkward)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    mine = [r for r in got if r.doc_id in quality and r.held_out]
    assert auc(np.array([r.score for r in mine]), [quality[r.doc_id] for r in mine]) > 0.98
    assert np.mean([r.predicted == quality[r.doc_id] for r in mine]) > 0.95


def test_held_out_and_negative_labels_teach_nothing(rows):
    """Other labels on held-out rows, and none on negatives instead of 0 elsewhere, change little or nothing."""
    docs, quality, labels = corpus(2, 300)
    frame = corpora.frame(rows, docs)
    scores = lambda some: {r.doc_id: r.score for r in pq.classify(frame, rows(some, LABELS)).collect()}
    want = scores(labels)
    assert scores([(i, 1 - q if held_out(i) else q, *x) for i, q, *x in labels]) == want
    assert scores([(i, q, *x) for i, q, *x in labels if not held_out(i)]) == want


def test_scores_depend_on_the_text_alone(rows):
    docs, _, labels = corpus(3, 200)
    moved = [(i, t, "elsewhere") for i, t, _ in docs] + [(77_777, docs[0][1], None)]
    frame = corpora.frame(rows, moved).withColumn("lang", F.lit("xx"))
    got = {r.doc_id: r.score for r in pq.classify(frame, rows(labels, LABELS)).collect()}
    assert got[77_777] == got[0]


def test_prior_is_near_the_truth():
    rng = random.Random(5)
    made = lambda good: pq.features(t if good else spoiled(rng, t)) if (t := corpora.prose(rng, 60)) else None
    p = np.array([made(True) for _ in range(300)])
    for share in (0.3, 0.7, 0.9):
        u = np.array([made(rng.random() < share) for _ in range(600)])
        scaled = lambda x: np.clip((x - u.mean(0)) / (u.std(0) + 1e-4), -8, 8)
        assert abs(pq.estimate_prior(scaled(p), scaled(u)) - share) < 0.08


def test_risk_is_the_published_one():
    """The gradient is that of the unbiased risk where its negative part is positive, by differences."""
    rng = np.random.default_rng(1)
    p, u, prior = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (80, 3)), 0.3
    seen = []
    descend = pq._descend
    pq._descend = lambda gradient, width, steps: seen.append(gradient) or np.zeros(width + 1)
    try:
        pq.fit(p, u, prior)
    finally:
        pq._descend = descend
    mean, scale = u.mean(0), u.std(0) + 1e-4
    ps, us = (p - mean) / scale, (u - mean) / scale
    loss = lambda z: np.logaddexp(0, -z)
    risk = lambda w: prior * loss(ps @ w[:-1] + w[-1]).mean() + loss(-(us @ w[:-1] + w[-1])).mean() - prior * loss(-(ps @ w[:-1] + w[-1])).mean()
    w = np.array([0.2, -0.1, 0.3, 0.1])
    want = [(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(4) * 1e-5]
    assert np.allclose(seen[0](w), want, atol=1e-6)


@pytest.mark.parametrize("case", ["no labels", "no positives", "no documents", "all labelled"])
def test_lacking_samples(rows, case):
    docs, quality, labels = corpus(6, 60)
    if case == "no labels":
        labels = []
    if case == "no positives":
        labels = [(i, 0, 0, "", "") for i in quality]
    if case == "no documents":
        docs = []
    if case == "all labelled":
        labels = [(i, q, 0, "", "") for i, q in quality.items()]
    got = pq.classify(corpora.frame(rows, docs), rows(labels, LABELS)).collect()
    assert len(got) == len(docs)
    if case in ("no labels", "no positives"):
        assert {r.score for r in got} == {0.5}


def test_bounds_and_contradictions(rows):
    docs, quality, labels = corpus(7, 400)
    twice = [(i, 1 - q, *x) for i, q, *x in labels]
    none = pq.training_numbers(corpora.frame(rows, docs), rows(labels + twice, LABELS), "doc_id", "quality", 50, 60)
    assert none.where("trusted").count() == 0
    some = pq.training_numbers(corpora.frame(rows, docs + docs), rows(labels, LABELS), "doc_id", "quality", 50, 60).collect()
    assert len(set(some)) == len(some) and not any(held_out(r.doc_id) for r in some)
    assert 25 <= sum(r.trusted for r in some) <= 80 and 30 <= sum(not r.trusted for r in some) <= 95
