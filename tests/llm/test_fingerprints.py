import hashlib

from loomset.llm import fingerprints as fp
from pyspark.sql import functions as F

TEXTS = [
    "First passage here. Second one, with a comma; and more.\nThird line of words\n\n  indented. End",
    "", None, "x", "No end at all in this text of some words that go on", "a.  b,   c;\n d: e!  f?  \n\n g. ",
    "Ünï cödé wörds. Mehr, und mehr.\nÄhnlich.", "one. two. three. " * 200, ". , ; : ! ?\n\n\n", "y" * 5000,
]


def python_edits(rows):
    """Texts of the rows and their edited texts, by (doc_id, text); the next greater number lends."""
    ids = sorted({i for i, _ in rows if i is not None})
    out = []
    for i, t in rows:
        t = t or ""
        later = [j for j in ids if i is not None and j > i]
        n = later[0] if later else ids[0] if ids else None
        lender = min((u or "" for j, u in rows if j == n and n is not None), key=lambda u: hashlib.md5(u.encode()).hexdigest(), default="")
        q = len(t) // 4
        out.append((i, t, t[: len(t) - q] + lender[:q]))
    return out


def test_edited_texts_and_their_fingerprints(spark, rows):
    data = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "a row, without. number"), (3, "again, the number 3"), (0, TEXTS[0])]
    docs = rows(data, "doc_id bigint, text string").withColumn("k", F.lit(1)).withColumn("md5", F.lit("clash"))
    got = fp.edited_fingerprints(docs).collect()
    want = python_edits(data)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(
        ((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in want), key=key
    )
    direct = rows([(t,) for _, t, _ in want] + [(e,) for _, _, e in want], "text string").select("text", fp.fingerprint(F.col("text")).alias("f")).collect()
    lanes = {hashlib.sha256(r.text.encode()).hexdigest(): r.f for r in direct}
    assert all(r.edited_lanes == lanes[r.edited_sha256] for r in got)
    assert all(0.0 <= v <= 1.0 for r in got for v in (r.near_edited, r.near_next))


def test_order_insertion_and_deletion(rows):
    a, b = "one two. three four. five.", "six, seven\neight"
    r = rows([(a, b)], "a string, b string").select(
        fp.fingerprint(F.concat("a", F.lit("\n"), "b")).alias("ab"), fp.fingerprint(F.concat("b", F.lit("\n"), "a")).alias("ba"),
        fp.combine(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("sum"),
        fp.combine(fp.fingerprint(F.concat("a", F.lit("\n"), "b")), fp.fingerprint(F.col("b")), -1).alias("less"),
        fp.fingerprint(F.col("a")).alias("fa"), fp.spelled(fp.fingerprint(F.col("a"))).alias("s"),
    ).first()
    assert r.ab == r.ba == r.sum and r.less == r.fa and len(r.s) == 6 * (1 + fp.LANES)
    assert int(r.s[:6], 16) == 3


def test_repeats_count_and_likeness(rows):
    text = "".join(f"passage number {i} of it. " for i in range(40))
    other = "".join(f"other sentence {i * 7} there. " for i in range(40))
    r = rows([(text, text[: len(text) * 3 // 4] + other, other)], "a string, b string, c string").select(
        *[fp.likeness(fp.fingerprint(F.col(x)), fp.fingerprint(F.col(y))).alias(x + y) for x, y in ("aa", "ab", "ac")],
        fp.fingerprint(F.lit("again. again.")).alias("two"), fp.fingerprint(F.lit("again.")).alias("one"),
    ).first()
    assert r.aa == 1.0 and r.ab > 0.5 > r.ac and r.two != r.one


def test_empty_table_and_only_missing_numbers(rows):
    assert fp.edited_fingerprints(rows([], "doc_id bigint, text string")).count() == 0
    got = fp.edited_fingerprints(rows([(None, "abcdefgh"), (None, None)], "doc_id bigint, text string")).collect()
    assert {r.edited_sha256 for r in got} == {hashlib.sha256(t).hexdigest() for t in (b"abcdef", b"")}
