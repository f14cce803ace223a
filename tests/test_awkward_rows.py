"""Missing and repeated keys, one-sided pairs and absent losses."""

from collections import Counter

from loomset.operators import augment, embedding, encode, losses, split
from loomset.schema import TEXT_KIND
from pyspark.sql import functions as F


def test_encoding_is_the_same_joined(rows):
    docs = rows([(1, "a b c"), (1, "b z"), (None, "c c"), (None, None), (2, "")], "k long, text string")
    vocab = encode.build_vocab(docs, "text", size=3)
    ids = [Counter((r.k, tuple(r.input_ids)) for r in encode.encode(docs, "k", "text", vocab, 4, inline_limit=n).collect()) for n in (100, 0)]
    assert ids[0] == ids[1] and sum(ids[0].values()) == 5


def test_augmenting_is_the_same_joined(rows):
    docs = rows([(1, "a b c"), (1, "b z"), (None, "c c"), (None, None)], "k long, text string")
    lexicon = rows([("a", "A"), ("b", None), (None, "x"), ("c", "C"), ("c", "K")], "word string, replacement string")
    out = [
        augment.augment(docs, TEXT_KIND, "k", factor=3, lexicon=lexicon, inline_limit=n) for n in (100, 0)
    ]
    assert out[0].columns == out[1].columns
    assert Counter(map(tuple, out[0].collect())) == Counter(map(tuple, out[1].collect()))


def test_one_sided_pairs_score_nothing(rows):
    data = [(1, "pred", 0, [1.0, 0.0]), (1, "ref", 0, [1.0, 0.0]), (2, "pred", 0, [1.0, 0.0]), (3, "ref", 0, [0.0, 1.0])]
    got = embedding.embedding_match(rows(data, "pair_id long, side string, pos long, vec array<double>")).collect()
    assert {(r.pair_id, r.p, r.r, r.f1) for r in got} == {(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)}


def test_nan_losses_are_absent(rows):
    nan = float("nan")
    log = rows([(1, 1, 0.5, nan), (1, 2, nan, 0.4), (1, 3, 0.3, nan)], "run_id long, step long, train_loss double, eval_loss double")
    assert {(r.step, r.eval_loss) for r in losses.loss_log(log).collect()} == {(1, None), (3, None)}
    assert losses.best_step(log).first().step == 2 and losses.final_loss(log).first().step == 3


def test_split_of_missing_keys(rows):
    docs = rows([(i,) for i in range(19)] + [(None,)], "k long")
    sizes = {r.split: r.n for r in split.split_sizes(split.with_split(docs, "k")).collect()}
    assert sizes == {"test": 2, "train": 18}
