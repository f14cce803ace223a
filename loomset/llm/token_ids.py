"""Token ids of whole texts in tasks, as the ``tokenizers`` library gives them for a tokenizer file.

For byte-level BPE files, texts of common characters go through ``tiktoken``, loaded with the
vocabulary and the special tokens of the same file, which gives the same ids several times as
fast. Whatever it could see otherwise, rare characters whose classes depend on a Unicode
version, special strings or another kind of file, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the published pattern by which byte-level BPE cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ASCII, and Latin letters with marks.
_common = re.compile(r"[\t\n\r\x20-~\xc0-\xd6\xd8-\xf6\xf8-ſ]*").fullmatch
_LONGEST_RUN = re.compile(r"[^\s]{2000}").search  # a run that the faster way would merge in quadratic time


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in such files: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The file for ``tiktoken``, if it is a plain byte-level BPE whose ids are in the order of its merges."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE" and spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    )
    if not plain:
        return None
    alphabet, special = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if len(ranks) != 256 + len(set(made)):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``ids(texts)``: the ids of each text as little-endian unsigned 32-bit integers, without added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._fast = _ranked(path)

    def plain(self, text: str) -> bool:
        """Whether both ways give the same ids for the text."""
        return self._fast is not None and not any(s in text for s in self._special) and bool(_common(text)) and not _LONGEST_RUN(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain(t) for t in texts]
        others = iter(self._tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [array("I", self._fast.encode_ordinary(t) if p else next(others).ids).tobytes() for t, p in zip(texts, plain)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the file at ``path``; it outlives a task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
