"""Whitespace, token and length expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loomset.schema import Kind, PREFERENCE_KIND, REWARD_KIND, TEXT_KIND

# Every character Unicode calls white space, as a string strip or split sees it.
WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as ranges; the lookahead dismisses most characters with one comparison.
WS_RUN = (
    "(?![!-~])[\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)
_SPACE = "\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACED_TOKEN = f"[{_SPACE}]*+[^{_SPACE}]++"  # a token and the white space before it


def strip(c: Column | str) -> Column:
    """Remove white space (Unicode, not only blanks) from both ends."""
    return F.btrim(_col(c), F.lit(WS))


def tokens(c: Column | str) -> Column:
    """White-space tokens; NULL and blank text give an empty array.

    To unfold them use ``explode_outer`` and drop NULLs: ``explode`` has the optimizer
    repeat the whole expression in a filter for empty arrays.
    """
    return _no_blanks(F.split(strip(c), WS_RUN))


def alnum_text(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9 with blanks for all else."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")


def _no_blanks(words: Column) -> Column:
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def first_tokens(c: Column | str, limit: int) -> Column:
    """The text up to the end of its token number ``limit``; as it is if it has no more tokens."""
    text = _col(c)
    cut = bind(
        F.regexp_extract_all(text, F.lit(_SPACED_TOKEN), F.lit(0)),
        lambda words: F.when(F.size(words) <= limit, text).otherwise(F.array_join(F.slice(words, 1, limit), "")),
    )
    # n characters hold at most (n + 1) / 2 tokens.
    return F.when(F.length(text) < 2 * limit, text).otherwise(cut)


def size0(c: Column | str) -> Column:
    """Length in code points, NULL counting as empty."""
    return F.coalesce(F.length(_col(c)), F.lit(0))


def example_length(kind: Kind) -> Column:
    """Characters over all the fields of an example."""
    total = size0(kind.columns[0])
    for name in kind.columns[1:]:
        total = total + size0(name)
    return total


def is_kept(kind: Kind) -> Column:
    """False for examples without content; a preference, with or without a prompt, needs every field."""
    if kind in (PREFERENCE_KIND, REWARD_KIND):
        keep = size0(kind.columns[0]) > 0
        for name in kind.columns[1:]:
            keep = keep & (size0(name) > 0)
        return keep
    return example_length(kind) > 0


def within_bounds(kind: Kind, low: int, high: int) -> Column:
    """Inclusive length bounds; an instruction pair gets twice the upper bound."""
    if kind is PREFERENCE_KIND:
        prompt, chosen, _ = kind.columns
        return size0(prompt).between(low, high) & size0(chosen).between(low, high)
    if kind in (TEXT_KIND, REWARD_KIND):
        return size0(kind.columns[0]).between(low, high)
    return example_length(kind).between(low, 2 * high)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression named inside a lambda is otherwise computed again for every element,
    also when it was a column of its own that the optimizer merged away.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
