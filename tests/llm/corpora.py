"""Small tables for the tests of the corpus operators, with awkward rows."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, content string, found int, k int, kept string"


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.', '.' + chr(10)])}" for _ in range(n)).strip()


def edit(rng: random.Random, text: str, share: float) -> str:
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split(" "))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose, exact and near copies, empty, NULL and very long texts, repeated rows, NULL ids and sources."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 300)), f"src{i % 4}") for i in range(n)]
    base = prose(rng, 200)
    rows += [(1000 + i, edit(rng, base, i / 400), "src0") for i in range(30)]
    rows += [(2000 + i, base, "src1") for i in range(5)]
    rows += [(3000, "", "src2"), (3001, None, "src2"), (3002, " \t\n ", "src3"), (3003, "one", None), (3004, "ONE", "src1"), (3005, "one two", None)]
    rows += [(3006, prose(rng, 30000), "long"), (3006, base.upper(), "long"), (None, base, "src1"), (None, "nothing like it " * 30, None)]
    rows += [rows[3], rows[3], (None, None, None), (3010, "naïve café, 日本語 𝒳 " * 40, "src3"), (3011, "z" * 20000, "src3")]
    rows += [(3012, "same three words " * 60, "src2"), (3013, "$$$ ### *** % & | < > " * 30, "src0")]
    return rows


def frame(rows, data=None):
    """The documents with extra columns whose names the operators use themselves."""
    data = documents() if data is None else data
    return rows([(i, t, "en", s, None if t is None else len(t), "clash", 7, 8, "no") for i, t, s in data], DOCS)
