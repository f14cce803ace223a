"""Porter stemming (M. F. Porter, 1980) in the widely used extended form, for Arrow UDFs."""

from __future__ import annotations

import re

# Words with their own stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement, tried in this order; the first suffix that fits decides.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
MIN_STEMMED = 4  # shorter tokens stay as they are


def shape(word: str) -> str:
    """'v' or 'c' per letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    """consonant-vowel-consonant at the end (not w, x, y), or a two-letter vowel-consonant word."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        base = w.removesuffix(suffix)
        if base != w and "v" in shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if re.search(r"(.)\1$", base) and shape(base).endswith("c"):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if measure(base) == 1 and _short_end(base) else base
    return w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and shape(w[:-1]).endswith("c") else w


def _derived(w: str, rules: dict[str, str]) -> str:
    for suffix, new in rules.items():
        if w.endswith(suffix):
            base = w.removesuffix(suffix)
            # the l of "logi" belongs to the measured part
            return base + new if measure(base + "l" if suffix == "logi" else base) > 0 else w
    return w


def _step_2(w: str) -> str:
    out = _derived(w, STEP_2)
    return _step_2(out) if w.endswith("alli") and out != w else out


def _residue(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            base = w.removesuffix(suffix)
            return base if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")) else w
    return w


def _final_e(w: str) -> str:
    base = w[:-1]
    if w.endswith("e"):
        m = measure(base)
        return base if m > 1 or (m == 1 and not _short_end(base)) else w
    return w


def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    w = _step_2(_final_y(_past(_plural(word))))
    w = _final_e(_residue(_derived(w, STEP_3)))
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


_seen: dict[str, str] = {}
_SEEN_MAX = 1 << 20


def _stem_once(word: str) -> str:
    """The stem, remembered by the task: frequent words are worked out once."""
    if len(word) < MIN_STEMMED:
        return word
    if word not in _seen:
        if len(_seen) >= _SEEN_MAX:
            _seen.clear()
        _seen[word] = stem(word)
    return _seen[word]


def stemmed_words(text: str) -> list[str]:
    """The stems of a text's words, for use inside a task."""
    return [_stem_once(w) for w in text.split()]
