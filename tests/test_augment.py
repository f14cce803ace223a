import pytest

from loomset.operators import augment
from loomset.schema import INSTRUCTION_KIND, PREFERENCE_KIND, TEXT_KIND

TEXTS = ["the cat sat on the mat", "x", "", None, "cat " * 80, "no hits\nhere"]


@pytest.fixture
def texts(rows):
    return rows(list(enumerate(TEXTS)), "id int, text string")


@pytest.fixture
def lexicon(rows):
    return rows([("cat", "feline"), ("cat", "kitty"), ("mat", "rug"), ("the", "a")], "word string, replacement string")


def by_copy(df, column="text"):
    return {(r.id, r.copy_no): r[column] for r in df.collect()}


def test_replicate_and_report(texts):
    out = augment.replicate(texts, 3)
    assert out.count() == 18
    assert tuple(augment.augment_report(out).first()) == (6, 18)


def test_join_and_broadcast_agree(texts, lexicon):
    inline = by_copy(augment.augment(texts, TEXT_KIND, "id", 4, "synonym", lexicon))
    joined = by_copy(augment.augment(texts, TEXT_KIND, "id", 4, "synonym", lexicon, inline_limit=0))
    assert inline == joined
    assert all(inline[i, 0] == t for i, t in enumerate(TEXTS))


def test_number_of_replacements(texts, lexicon):
    got = by_copy(augment.augment(texts, TEXT_KIND, "id", 2, "spelling", lexicon))
    changed = lambda a, b: sum(x != y for x, y in zip(a.split(), b.split()))
    assert changed(TEXTS[0], got[0, 1]) == 1  # 30 % of 6 words
    assert changed(TEXTS[4], got[4, 1]) == 10  # never more than 10
    assert {w for w in got[4, 1].split()} <= {"cat", "feline", "kitty"}
    assert got[1, 1] == "x" and got[5, 1] == TEXTS[5] and got[2, 1] == "" and got[3, 1] is None


def test_random_word_deletes_but_keeps_one(texts):
    got = by_copy(augment.augment(texts, TEXT_KIND, "id", 2, "random_word"))
    assert len(got[0, 1].split()) == 5
    assert len(got[4, 1].split()) == 70
    assert got[1, 1] == "x" and got[2, 1] == "" and got[3, 1] is None


def test_copies_differ_but_runs_agree(texts, lexicon):
    runs = [by_copy(augment.augment(t, TEXT_KIND, "id", 5, "synonym", lexicon)) for t in (texts, texts.repartition(3))]
    assert runs[0] == runs[1]
    assert len({runs[0][4, c] for c in range(5)}) == 5


def test_which_column_changes(rows, lexicon):
    pairs = rows([(1, "cat", "cat")], "id int, instruction string, output string")
    out = augment.augment(pairs, INSTRUCTION_KIND, "id", 2, "unknown method", lexicon).where("copy_no = 1").first()
    assert out.instruction in ("feline", "kitty") and out.output == "cat"
    prefs = rows([(1, "cat", "cat", "cat")], "id int, prompt string, chosen string, rejected string")
    out = augment.augment(prefs, PREFERENCE_KIND, "id", 2, "synonym", lexicon).collect()
    assert [tuple(r)[1:4] for r in out] == [("cat",) * 3] * 2


def test_extent_of_changes(rows):
    texts = rows([(1, " ".join(f"w{i}" for i in range(100)))], "id int, text string")
    lexicon = rows([(f"w{i}", "new") for i in range(100)], "word string, replacement string")
    for options, want in (({}, 10), ({"most": None}, 30), ({"share": 0.05}, 5), ({"share": 0.0, "least": 3}, 3)):
        for inline in (1000, 0):
            out = augment.augment(texts, TEXT_KIND, "id", 2, "synonym", lexicon, inline_limit=inline, **options)
            assert out.where("copy_no = 1").first().text.split().count("new") == want
        short = augment.augment(texts, TEXT_KIND, "id", 2, "random_word", **options).where("copy_no = 1").first()
        assert len(short.text.split()) == 100 - want


def test_small_tables_are_small_in_bytes_too(rows):
    from pyspark.sql import functions as F
    from loomset.runtime import small_table

    table = rows([("x" * 50,), ("y",)], "word string")
    assert len(small_table(table, 2, F.octet_length("word"))) == 2
    assert small_table(table, 1, F.octet_length("word")) is None
    assert small_table(table, 2, F.octet_length("word"), max_bytes=50) is None


def test_texts_send_no_more_words_to_a_large_lexicon_than_may_change(rows, monkeypatch):
    import random

    rng, asked, met = random.Random(2), [], augment._met
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 400)))) for i in range(30)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w5"), (None, None)]
    texts = rows(data, "id int, text string")
    monkeypatch.setattr(augment, "_met", lambda candidates, *rest: asked.append(candidates.count()) or met(candidates, *rest))
    for known, rounds in ((300, 1), (40, 2)):
        lexicon = rows([(w, f"{w}{x}") for w in words[:known] for x in "ab"], "word string, replacement string")
        asked.clear()
        runs = [augment.augment(texts, TEXT_KIND, "id", 3, "synonym", lexicon, inline_limit=n).collect() for n in (1000, 0)]
        assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
        assert len(asked) >= rounds and asked[0] <= 10 * 2 * len(data)
        assert any("a " in str(r) for r in runs[1])


def test_phrases_of_a_large_lexicon(rows):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("abcdefg", k=n))
    texts = rows([(i, text(rng.randrange(60))) for i in range(60)] + [(1, "a  b\tc"), (1, "a  b\tc"), (None, "a b"), (None, None), (7, "")], "id int, text string")
    entries = [(text(rng.randrange(1, 4)), f"<{i}>") for i in range(60)] + [("  a   b ", "<ab>"), ("", "x"), (" ", "y"), (None, "z"), ("c d e f g", "<five>")]
    lexicon = rows(entries, "word string, replacement string")
    for options in ({}, {"most": None, "share": 0.9}):
        runs = [augment.augment(texts, TEXT_KIND, "id", 3, "synonym", lexicon, inline_limit=n, **options).collect() for n in (1000, 0)]
        assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
        assert any("<" in str(r) for r in runs[1])


def test_a_large_lexicon_is_shuffled_once_to_join_its_words(rows, monkeypatch):
    written, plain = [], augment.materialise
    monkeypatch.setattr(augment, "materialise", lambda df, label: written.append((label, df)) or plain(df, label))
    texts = rows([(i, f"w{i} w{i + 1} of") for i in range(50)], "id int, text string")
    lexicon = rows([(f"w{i}", f"v{i}") for i in range(40)] + [("of", "on"), ("of", "in")], "word string, replacement string")
    monkeypatch.setattr(augment, "hot_keys", lambda df, key: ["of"])
    runs = [augment.augment(texts, TEXT_KIND, "id", 3, "synonym", lexicon, inline_limit=n).collect() for n in (1000, 0)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    assert "options" not in [label for label, _ in written]
    texts.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = augment._met(texts.selectExpr("id", "concat('w', id) as code"), lexicon.groupBy(lexicon.word.alias("code")).count(), "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        texts.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Words that are not hot: one shuffle of each side, none after the lexicon has been grouped.
    assert plan.split("Union")[1].split("\n   +- ")[0].count("Exchange hashpartitioning(") == 2
    assert met.count() == 50
