"""Personal data by patterns of form, and by bootstrapped contexts.

What has the form of an e-mail address, network address, card or phone number is found in the
text itself. These seeds induce lexical patterns, the two words before them; Spark scores the
graph of patterns and the instances they extract in turns, and patterns of high confidence
discover identifiers whose form is unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import digest, hot_keys, salted_join, slices, text_of, unused
from loomset.llm.words import window_hashes, word_hashes
from loomset.runtime import materialise

# The kinds in order, with their forms. Look-behinds only keep a search from
# starting inside a run whose every start would end alike, so that long runs cost linear time.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++" + _DOMAIN)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# An unknown identifier: letters, digits and joints with at least two digits, or a handle.
_IDENTIFIER = re.compile(r"(?=.*[0-9].*[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{3,}|@[A-Za-z0-9_.]{3,}")
_TELLING = re.compile(rb"[0-9@]")  # no seed and no identifier is without one of these
_EDGES = ".,;:!?()[]{}<>\"'"
_LONGEST = 64

CONTEXT = "context"  # the kind of what patterns discover
LEAST_SEEDS = 3  # different seeds that make a pattern
ROUNDS = 3
CONFIDENT = 0.8
BLOOM_BITS = 1 << 22
SLOTS = 1 << 19

_SPAN = "struct<kind:int,start:int,end:int>"
_FOUND = f"struct<spans:array<{_SPAN}>,seeds:array<struct<pattern:bigint,form:bigint>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start; code points."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def form(token: str) -> int:
    """The number of an instance: a hash of its text, ASCII lower-cased."""
    return _signed(xxhash.xxh3_64_intdigest(token.encode().lower()))


def pattern_before(text: str, start: int) -> int | None:
    """The number of the pattern that the two words before ``start`` make."""
    tail, reach = "", 128
    while len(words := (tail := text[max(0, start - reach) : start]).encode().split()) < 3 and len(tail) < start:
        reach *= 4
    if len(words) < 2:
        return None
    return int(window_hashes(word_hashes(b" ".join(words[-2:]).decode()), 2).view(np.int64)[0])


def _seeded(texts: pa.Array) -> pa.Array:
    out = []
    for some in slices(texts):
        for text in some:
            spans = base_spans(text or "")
            pairs = {(p, form(text[a:b])) for _, a, b in spans if (p := pattern_before(text, a)) is not None}
            out.append({
                "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                "seeds": [{"pattern": p, "form": f} for p, f in sorted(pairs)],
            })
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seed = pa.struct([("pattern", pa.int64()), ("form", pa.int64())])
    return pa.array(out, pa.struct([("spans", pa.list_(span)), ("seeds", pa.list_(seed))]))


def _bloom(patterns: DataFrame) -> bytes:
    """Bits of the patterns' numbers: ``BLOOM_BITS`` however many there are; a full one only lets more through."""
    places = patterns.select(F.explode(F.array(*[
        F.pmod(F.shiftrightunsigned("pattern", s), F.lit(BLOOM_BITS)) for s in (0, 24)
    ])).alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 8).cast("int").alias("byte")).agg(
        F.sum(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits")
    )
    bits = bytearray(BLOOM_BITS // 8)
    for row in places.toLocalIterator():
        bits[row["byte"]] = row["bits"]
    return bytes(bits)


def _known(bloom: bytes):
    """Whether patterns, as hashes of word pairs, are in the filter."""
    bits = np.frombuffer(bloom, np.uint8)

    def known(h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for shift in (0, 24):
            at = (h >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
            hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit

    return known


def _followers(text: str, known) -> Iterator[tuple[int, str, int | None]]:
    """(pattern, token, start) of what follows the patterns of a text; ``start`` is None for an ordinary word.

    What has a known form is left out: it is among the seeds.
    """
    pairs = window_hashes(word_hashes(text), 2)[:-1]
    at = np.flatnonzero(known(pairs)) if len(pairs) else []
    if not len(at):
        return
    words = text.encode().split()
    places = None
    for i in at.tolist():
        pattern, raw = int(pairs[i].view(np.int64)), words[i + 2]
        if not _TELLING.search(raw):
            yield pattern, raw.decode().strip(_EDGES), None
            continue
        places = places or [m.start() for m in _WORD.finditer(text)]
        start = places[i + 2]
        if any(a < len(raw) for _, a, _ in base_spans(text[start : start + 2 * _LONGEST])):
            continue  # a seed of the pattern
        token = raw.decode().strip(_EDGES)
        if len(token) > _LONGEST or not _IDENTIFIER.fullmatch(token):
            yield pattern, token, None
        else:
            yield pattern, token, start + raw.decode().index(token)


def _extractions(texts: DataFrame, bloom: bytes) -> DataFrame:
    """(content, pattern, form, start, end): identifier-like tokens that follow the patterns in each (content, text)."""

    def run(batches):
        known = _known(bloom)
        for batch in batches:
            rows = {n: [] for n in ("content", "pattern", "form", "start", "end")}
            for contents, some in zip(slices(batch.column(0)), slices(batch.column(1))):
                for content, text in zip(contents, some):
                    for pattern, token, start in _followers(text, known):
                        if start is not None:
                            for n, v in zip(rows, (content, pattern, form(token), start, start + len(token))):
                                rows[n].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["content"], pa.string()), *[pa.array(rows[n], pa.int64()) for n in list(rows)[1:]]], names=list(rows)
            )

    return texts.mapInArrow(run, "content string, pattern bigint, form bigint, start bigint, end bigint")


def _enough(n: Column) -> Column:
    """So many different misses, one to spare, keep a pattern of ``n`` instances from being confident."""
    return F.floor(n / F.lit(CONFIDENT) - n) + 1


def _misses(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, form): different ordinary words that follow the ``patterns`` (pattern, n), as many as can matter.

    A task gives of a pattern no more of them than are enough to reject it, so that a pattern
    that is not rejected has all of its own. The numbers travel as powers of two, the greatest of
    those whose patterns share a slot.
    """
    power = F.ceil(F.log2(_enough(F.col("n")))).cast("int")
    slots = patterns.groupBy(F.pmod("pattern", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max(power).alias("power"))
    powers = bytearray(SLOTS)
    for row in slots.toLocalIterator():
        powers[row["slot"]] = row["power"]
    bloom, powers = _bloom(patterns), bytes(powers)

    def run(batches):
        known = _known(bloom)
        missed: dict[int, set[int]] = {}
        for batch in batches:
            for some in slices(batch.column(0)):
                for text in some:
                    for pattern, token, start in _followers(text, known):
                        if start is None:
                            seen = missed.setdefault(pattern, set())
                            if len(seen) < 1 << powers[pattern % SLOTS]:
                                seen.add(form(token))
        pairs = [(p, f) for p in sorted(missed) for f in sorted(missed[p])]
        for low in range(0, len(pairs), 1 << 16):
            columns = zip(*pairs[low : low + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pattern", "form"])

    return texts.mapInArrow(run, "pattern bigint, form bigint")


def _links(extracted: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, form, seed) of all instances of the patterns, and (pattern, n) of those with enough instances to be confident."""
    known = seeds.select("form").distinct().withColumn("seed", F.lit(True))
    links = extracted.select("pattern", "form").union(seeds.select("pattern", "form")).distinct()
    links = materialise(links.join(known, "form", "left").withColumn("seed", F.coalesce("seed", F.lit(False))), "links")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(CONFIDENT) * (F.col("n") + 1))
    return links, materialise(sizes, "sizes")


def _confident(links: DataFrame, sizes: DataFrame, missed: DataFrame) -> DataFrame:
    """(pattern) with high confidence, after ``ROUNDS`` turns over the graph of patterns and instances.

    A pattern's confidence is the mean score of all different forms it extracts, ordinary words
    scoring 0, with one more miss added, so that copies and repeats on either side change nothing;
    an instance's score is 1 for a seed, else the chance that one of its patterns is right. Patterns
    that would not be confident if all their instances were right have no part in it. Edges and
    counts are combined before each shuffle.
    """
    misses = missed.distinct().groupBy("pattern").agg(F.count("*").alias("misses"))
    hopeful = sizes.join(misses, "pattern", "left").withColumn("misses", F.coalesce("misses", F.lit(0)))
    hopeful = materialise(hopeful.where(F.col("n") >= F.lit(CONFIDENT) * (F.col("n") + F.col("misses") + 1)), "hopeful")
    links = materialise(links.join(hopeful.select("pattern"), "pattern", "left_semi"), "links")
    scored = links.withColumn("score", F.col("seed").cast("double"))
    for _ in range(ROUNDS):
        held = scored.groupBy("pattern").agg(F.sum("score").alias("held"), F.count(F.when(F.col("seed"), 1)).alias("seeds"))
        p = F.col("held") / (F.col("n") + F.col("misses") + 1)
        patterns = materialise(held.join(hopeful, "pattern").select("pattern", "seeds", p.alias("p")), "patterns")
        doubted = salted_join(links, patterns, "pattern", "inner", hot_keys(links, "pattern"))
        chance = doubted.groupBy("form").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("chance"))
        scored = links.join(chance, "form", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0))))
    return patterns.where((F.col("p") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")


def find(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, spans) for every row of ``docs``: array of (kind, start, end), by kind, then start.

    Kinds count as ``KINDS`` lists them; the next number is ``CONTEXT``, what confident patterns
    have discovered beside the spans of known form, which all stay. Two words make a pattern if
    they precede ``LEAST_SEEDS`` different seeds. A NULL text is empty; keys may be NULL;
    repeated rows are all returned; an empty table gives an empty one; other columns are ignored.
    """
    whole = text_of(text)
    rows = docs.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], digest(whole).alias("content"), F.arrow_udf(_seeded, _FOUND)(whole).alias("f")
    )
    rows = materialise(rows.select(*[c for c in rows.columns if c != "f"], "f.*"), "seeded")
    seeds = rows.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    patterns = materialise(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS), "patterns")
    names = [F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)]
    if patterns.isEmpty():
        return rows.select(*names, "spans")
    seeds = seeds.join(patterns.select("pattern"), "pattern", "left_semi")
    texts = docs.select(digest(whole).alias("content"), whole.alias("text"))
    found = _extractions(texts, _bloom(patterns)).join(patterns.select("pattern"), "pattern", "left_semi")
    found = materialise(found, "extracted")
    links, sizes = _links(found, seeds)
    if sizes.isEmpty():
        return rows.select(*names, "spans")
    missed = _misses(texts.select("text"), sizes).join(sizes.select("pattern"), "pattern", "left_semi")
    adopted = materialise(_confident(links, sizes, missed), "adopted")
    hits = found.join(adopted, "pattern", "left_semi")
    span = F.struct(F.lit(len(KINDS)).alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    more = hits.select("content", span.alias("span")).distinct().groupBy("content").agg(F.array_sort(F.collect_list("span")).alias("more"))
    joined = salted_join(rows, more, "content", "left", hot_keys(rows, "content"))
    free = F.filter("more", lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return joined.select(*names, F.concat("spans", F.coalesce(free, F.array().cast(f"array<{_SPAN}>"))).alias("spans"))


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)]), number + 1)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out, names = [], (*KINDS, CONTEXT)
    for some, marks in zip(slices(texts), slices(spans)):
        for text, own in zip(some, marks):
            parts, at = [], 0
            for s in sorted(own or [], key=lambda s: (s["start"], -s["end"])):
                if s["end"] > at:
                    parts += [text[at : max(at, s["start"])], f"[{names[s['kind']].upper()}]"]
                    at = s["end"]
            out.append("".join(parts) + text[at:] if parts else text)
    return pa.array(out, pa.string())


def mask(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs``, all columns, with the spans that ``find`` gives replaced by their kind in brackets.

    Overlapping spans are covered by one mark each, in order of their starts. Texts without
    spans, NULL texts included, stay as they are. ``length`` names a column that holds the text's length.
    """
    key = unused(docs, "content")
    keyed = docs.withColumn(key, digest(text_of(text)))
    spans = find(docs.select(F.col(text).alias("text")).withColumn("content", digest(text_of("text"))), ["content"])
    spans = spans.where(F.size("spans") > 0).groupBy("content").agg(F.first("spans").alias("spans"))
    marks = unused(keyed, "marks")
    joined = salted_join(keyed, spans.select(F.col("content").alias(key), F.col("spans").alias(marks)), key, "left", hot_keys(keyed, key))
    new = F.when(F.col(marks).isNull(), F.col(text)).otherwise(F.arrow_udf(_masked, "string")(text_of(text), F.col(marks)))
    out = joined.withColumn(text, new)
    if length:
        out = out.withColumn(length, F.when(F.col(marks).isNull(), F.col(length)).otherwise(F.length(text)))
    return out.select(*docs.columns)
