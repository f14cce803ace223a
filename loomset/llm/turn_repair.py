"""Conversation structure repair by Wagner-Fischer alignment with the grammar of turns.

The roles of a conversation should read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. A conversation's rows are aligned with the grammar's string of each feasible
length, which all end alike and share a table, inside Ukkonen bands; the audits (edits in order, as
letters) of the equally cheap lengths are traced back and the least one wins.

A long conversation is cut into blocks of rows. A block is aligned for every state of the grammar
it may be entered and left in; costs are composed over the blocks, backwards, and one pass forwards
picks each block's audit, so that no task holds the rows of a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.common import hot_keys, salted_join, slices, small
from loomset.operators.batching import with_ordinal
from loomset.runtime import materialise

# The costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
KINDS = 20  # digests modulo this choose the damage
DROPPED, EMPTIED, UNSTOPPED, REPEATED, AS_USER = range(5)
STOPS = ".!?"
FAULTS = ("blank", "duplicate", "truncated")
_BLANK = "\x20\x09-\x0D"

LONG_ROWS, LONG_BYTES = 1000, 8 << 20  # a conversation beyond either is repaired in blocks
BLOCK = 64  # rows of a block
SHORT, CACHED = 16, 50_000  # a worker remembers so many alignments of so few rows
_NEVER = 1 << 60

# Grammar states: nothing yet, after a system, a user, an assistant turn. What may follow: letter -> state.
BEGIN, SYSTEM, USER, ASSISTANT = "0sua"
FOLLOWS = {BEGIN: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
STATES = BEGIN + SYSTEM + USER + ASSISTANT
FINAL = (BEGIN, ASSISTANT)

Row = tuple[str, bool, bool]  # the role's initial, whether the row has to go, whether it is truncated


def suffix_costs(rows: tuple[Row, ...], end: str, limit: int, open_end: bool) -> list[list[int]]:
    """[i][j]: the least cost of turning the rows from ``i`` on into the last ``j`` letters of ``...uaua`` up to ``end``.

    The strings of all lengths have these ends in common, so that one table serves them all. Filled
    is the band of cells whose difference in length alone costs no more than ``limit``; costs above
    it are ``_NEVER``. Without ``open_end`` nothing is inserted after the last row.
    """
    n, behind, ahead = len(rows), limit // DELETE, limit // INSERT
    width = n + ahead + 1
    below = [INSERT * j if j <= ahead and (open_end or j == 0) else _NEVER for j in range(width)]
    table = [below]
    for i in range(n - 1, -1, -1):
        initial, gone, truncated = rows[i]
        extra = _NEVER if gone else TRUNCATED if truncated else 0
        other = USER if end == ASSISTANT else ASSISTANT
        prices = (extra + (REROLE if initial != other else 0), extra + (REROLE if initial != end else 0))
        here, last = [_NEVER] * width, _NEVER
        low = max(0, n - i - behind)
        for j in range(low, n - i + ahead + 1):
            cost = min(below[j] + DELETE, last + INSERT, below[j - 1] + prices[j & 1] if j else _NEVER)
            here[j] = last = cost if cost <= limit else _NEVER
        table.append(here)
        below = here
    table.reverse()
    return table


def _backtrace(rows: tuple[Row, ...], end: str, table: list[list[int]], i: int, j: int) -> str:
    """The least of the audits that cost ``table[i][j]``: a letter leads to one cell, so the least fitting one goes first."""
    audit, n = [], len(rows)
    while i < n or j:
        cost = table[i][j]
        if i < n and table[i + 1][j] + DELETE == cost:
            audit.append("D")
            i += 1
        elif j and table[i][j - 1] + INSERT == cost:
            audit.append("I")
            j -= 1
        else:
            letter = end if j % 2 else USER if end == ASSISTANT else ASSISTANT
            audit.append("K" if rows[i][0] == letter else "R")
            i, j = i + 1, j - 1
    return "".join(audit)


def align(rows: tuple[Row, ...], state: str, end: str, limit: int, open_end: bool) -> tuple[int, str] | None:
    """The least (cost, audit) from ``state`` to ``end`` over the strings of all lengths; None if above ``limit``."""
    n = len(rows)
    deleted = DELETE * n
    systems = [i for i, (initial, gone, _) in enumerate(rows) if initial == SYSTEM and not gone] if state == BEGIN else []
    extra = lambda i: TRUNCATED if rows[i][2] else 0
    if end in (BEGIN, SYSTEM):
        if state == end:
            return (deleted, "D" * n) if deleted <= limit else None
        # The last of equally cheap rows has the least audit.
        kept = min(((deleted - DELETE + extra(i), -i) for i in systems), default=None)
        return (kept[0], "D" * -kept[1] + "K" + "D" * (n - 1 + kept[1])) if kept and kept[0] <= limit else None
    table = suffix_costs(rows, end, limit, open_end)
    lengths = lambda first: range(1 if first == end else 2, len(table[0]), 2)
    whole = [*([0] if state == end else []), *lengths(ASSISTANT if state == USER else USER)]
    best = min(
        min((table[0][j] for j in whole), default=_NEVER),
        min((DELETE * i + extra(i) + table[i + 1][j] for i in systems for j in lengths(USER)), default=_NEVER),
    )
    if best > limit:
        return None
    audits = [_backtrace(rows, end, table, 0, j) for j in whole if table[0][j] == best]
    for i in reversed(systems):
        led = [j for j in lengths(USER) if DELETE * i + extra(i) + table[i + 1][j] == best]
        if led:  # an earlier row kept leaves a greater audit
            audits += ["D" * i + "K" + _backtrace(rows, end, table, i + 1, j) for j in led]
            break
    return best, min(audits)


def best_between(rows: tuple[Row, ...], state: str, end: str, open_end: bool) -> tuple[int, str] | None:
    """The least (cost, audit) from ``state`` to ``end``; None if there is no way.

    The band starts from what the rows that have to go, and a few edits, cost, and is widened until
    an alignment within it is found.
    """
    most = DELETE * len(rows) + 2 * INSERT  # all deleted, and a pair inserted
    limit = DELETE * sum(gone for _, gone, _ in rows) + 4 * INSERT
    while True:
        found = align(rows, state, end, min(limit, most), open_end)
        if found is not None or limit >= most:
            return found
        limit *= 2


def _whole(rows: tuple[Row, ...]) -> tuple[int, str]:
    return min(found for end in FINAL if (found := best_between(rows, BEGIN, end, True)) is not None)


_remembered = lru_cache(CACHED)(_whole)


def best_audit(rows: tuple[Row, ...]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return _remembered(rows) if len(rows) <= SHORT else _whole(rows)


def leaves(rows: Iterable[Row], audit: str, state: str = BEGIN) -> Iterator[tuple[int | None, str | None, str]]:
    """(row or None for an inserted one, new role or None, state after) of the turns that ``audit`` leaves."""
    i, initials = 0, [r[0] for r in rows]
    for letter in audit:
        at = None
        if letter != "I":
            at, i = i, i + 1
        if letter == "D":
            continue
        turn = initials[at] if letter == "K" else next(t for t in FOLLOWS[state] if t != "s")
        state = FOLLOWS[state][turn]
        yield at, None if letter == "K" else {"u": "user", "a": "assistant"}[turn], state


def _illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au")


# --- damage


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy) after damage; ``copy`` is NULL for a dropped row, 1 for a repetition, else 0.

    The digest of ``conv:turn`` chooses the damage. NULL roles and texts, and NULL numbers inside the
    digest, read as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(KINDS))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind")
    )
    copies = F.when(F.col("kind") == REPEATED, F.array(F.lit(0), F.lit(1))).when(F.col("kind") == DROPPED, F.array(F.lit(None).cast("int")))
    return rows.select(
        "conv", "turn",
        F.when(F.col("kind") == AS_USER, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == EMPTIED, F.lit("")).when(F.col("kind") == UNSTOPPED, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.coalesce(copies, F.array(F.lit(0)))).alias("copy"),
    )


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_BLANK}]")


def is_truncated(text: Column) -> Column:
    """Whether the last character that is not blank does not end a sentence."""
    return ~text.rlike(rf"[{STOPS}][{_BLANK}]*\z")


_ORDER = ("turn", "role", "text", "copy")  # a conversation's rows, NULL turns first
RESULT = "conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Conversation:
    """The rows of one conversation as they come, in order, and what its repair gives."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.turns: list[int] = []
        self.said: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.faults = dict.fromkeys(FAULTS, 0)

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool) -> None:
        again = (role, text) in self.seen
        fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
        if fault:
            self.faults[fault] += 1
        self.seen.add((role, text))
        self.said.append((role, text))
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if turn is not None:
            self.turns.append(turn)

    def result(self) -> tuple:
        gaps = max(self.turns) - min(self.turns) + 1 - len(set(self.turns)) if self.turns else 0
        illegal = sum(_illegal(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:]))
        cost, audit = best_audit(tuple(self.rows))
        lines = []
        for at, role, _ in leaves(self.rows, audit):
            old, text = ("", "") if at is None else self.said[at]
            lines.append(f"{old if role is None else role}:{text}")
        return gaps, *self.faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for some in zip(*[slices(batch.column(n)) for n in names]):
        yield from zip(*some)


def _repair_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from rows that are sorted by conversation and place."""
    out: list[tuple] = []
    current, state = None, None

    def flush(schema: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 9
        done = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], schema), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]],
            names=["conv", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"],
        )
        out.clear()
        return done

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turn, role, text, copy, blank, truncated in _rows(batch, "conv", "turn", "role", "text", "copy", "blank", "truncated"):
            if state is None or conv != current:
                if state is not None:
                    out.append((current, *state.result()))
                current, state = conv, Conversation()
            if copy is not None:
                state.add(turn, role, text, blank, truncated)
        if len(out) > 1000:
            yield flush(kind)
    if state is not None:
        out.append((current, *state.result()))
        yield flush(kind)


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"blank": is_blank(F.col("text")), "truncated": is_truncated(F.col("text"))})


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of ``turns``.

    ``turns`` is damaged first (:func:`damaged`). Rows are taken by turn, NULL turns first, and rows
    of one turn by role, text and copy. Empty and blank texts have to go; a NULL conversation is one
    like others; repeated rows are duplicates; a role whose initial is not of the grammar, the empty
    one too, has to change or go; a conversation without rows after damage has zeros, an empty audit
    and the digest of the empty text; an empty table gives an empty one; other columns are ignored.
    Conversations of more than ``long_rows`` rows or ``long_bytes`` of text go in blocks, to the same
    result.
    """
    rows = damaged(turns, conv, turn, role, text)
    result = RESULT.format(conv=rows.schema["conv"].dataType.simpleString())
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialise(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv"), "long")
    short, split = rows, None
    if not long.isEmpty():
        is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
        named = long.select(F.col("conv").alias("long_conv"))
        named = F.broadcast(named) if small(named, F.lit(64)) else named
        short, split = rows.join(named, is_long, "left_anti"), rows.join(named, is_long, "left_semi")
    placed = _flagged(short).repartition("conv").sortWithinPartitions("conv", *_ORDER)
    done = placed.mapInArrow(_repair_each, result)
    if split is not None:
        done = done.unionByName(_repair_long(split, result))
    return done.withColumnRenamed("conv", conv)


# --- long conversations


def _by_conversation(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], fresh, step, finish, kind: list) -> Iterator[tuple]:
    """Fold the sorted rows of each conversation: ``step(state, row)`` may yield; ``finish(state)`` ends one."""
    current, state = None, None
    for batch in batches:
        kind[:] = [batch.schema.field("conv").type]
        for row in _rows(batch, *names):
            if state is None or row[0] != current:
                if state is not None:
                    yield from finish(current, state)
                current, state = row[0], fresh()
            yield from step(state, row)
    if state is not None:
        yield from finish(current, state)


def _folded(fields: str, names: tuple[str, ...], fresh, step, finish):
    """A function for mapInArrow that folds conversations and gives rows of the ``fields`` after ``conv``."""
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    named = [f.split() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind[0]), *[pa.array(c, types[t]) for c, (_, t) in zip(columns[1:], named)]],
                names=["conv", *[n for n, _ in named]],
            )

        for row in _by_conversation(batches, names, fresh, step, finish, kind):
            out.append(row)
            if len(out) >= 256:
                yield flush()
        if out:
            yield flush()

    return run


_WAYS = [(a, b) for a in STATES for b in STATES]
_NO_WAY = -1


def _costs(rows: tuple[Row, ...], open_end: bool) -> list[int]:
    found = [best_between(rows, a, b, open_end) for a, b in _WAYS]
    return [_NO_WAY if f is None else f[0] for f in found]


def _pack(rows: list[Row]) -> str:
    """One letter pair a row: its initial, a blank standing for those outside the grammar, and what is wrong."""
    return "".join((r[0] if r[0] in ("s", "u", "a") else " ") + ("x" if r[1] else "t" if r[2] else "-") for r in rows)


def _unpack(codes: str) -> tuple[Row, ...]:
    return tuple((codes[i].strip(), codes[i + 1] == "x", codes[i + 1] == "t") for i in range(0, len(codes), 2))


def _repair_long(rows: DataFrame, result: str) -> DataFrame:
    """As the short way, over blocks of consecutive rows.

    Duplicates are the rows of a conversation, role and text that are not the first of them. A task
    of the last pass streams a conversation's repaired text in order, which its digest needs.
    """
    conv_type = rows.schema["conv"].dataType.simpleString()
    all_convs = rows.select("conv").distinct()
    there = _flagged(rows.where("copy is not null"))
    placed = materialise(with_ordinal(there, "conv", *_ORDER, name="at"), "turns")
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    named = F.coalesce(sized(F.col("conv").cast("string")), F.lit("-"))
    placed = placed.withColumn("said", F.sha2(F.concat(named, sized(F.col("role")), "text"), 256))
    firsts = placed.groupBy("said").agg(F.min("at").alias("first"))
    hot = hot_keys(placed, "said")
    marked = salted_join(placed, firsts, "said", "left", hot).withColumn("again", F.col("at") > F.col("first"))
    starts = placed.groupBy("conv").agg(F.min("at").alias("start"))
    starts = F.broadcast(starts) if small(starts, F.lit(64)) else starts
    marked = marked.withColumnRenamed("conv", "c").join(starts, F.col("c").eqNullSafe(F.col("conv"))).drop("c")
    block = F.floor((F.col("at") - F.col("start")) / BLOCK)
    marked = materialise(marked.select("conv", block.alias("block"), "at", "turn", "role", "text", "blank", "truncated", "again"), "marked")

    # A row per block: its rows as codes, counts, and the costs between all states.
    def coded(state: list, row: tuple) -> Iterator[tuple]:
        _, number, initial, blank, truncated, again = row
        if state and state[0] != number:
            yield from coded_end(row[0], state)
            state.clear()
        if not state:
            state.extend([number, [], [0, 0, 0]])
        gone = blank or again
        state[1].append((initial, gone, truncated and not gone))
        if blank or again or truncated:
            state[2][0 if blank else 1 if again else 2] += 1

    def coded_end(conv, state: list) -> Iterator[tuple]:
        number, block_rows, faults = state
        packed = tuple(block_rows)
        illegal = sum(_illegal(a[0], b[0]) for a, b in zip(packed, packed[1:]))
        yield conv, number, _pack(block_rows), *faults, illegal, _costs(packed, False)

    light = marked.select("conv", "block", "at", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "again")
    light = light.repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    fields = "block bigint, codes string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, inner array<bigint>"
    blocks = materialise(light.mapInArrow(
        _folded(fields, ("conv", "block", "initial", "blank", "truncated", "again"), list, coded, lambda c, s: coded_end(c, s) if s else ()),
        f"conv {conv_type}, {fields}",
    ), "blocks")

    # Backwards: what the blocks after this one cost from each state.
    def backward(state: dict, row: tuple) -> Iterator[tuple]:
        conv, number, codes, blank, duplicate, truncated, illegal, inner = row
        after = state.get("after")
        ends = [0 if s in FINAL else _NO_WAY for s in STATES] if after is None else after
        ways = _costs(_unpack(codes), True) if after is None else inner
        yield conv, number, codes, blank, duplicate, truncated, illegal, ends, after is None
        totals = [
            [ways[a * 4 + b] + ends[b] for b in range(4) if ways[a * 4 + b] != _NO_WAY and ends[b] != _NO_WAY] for a in range(4)
        ]
        state["after"] = [min(t, default=_NO_WAY) for t in totals]

    names = ("conv", "block", "codes", "blank", "duplicate", "truncated", "illegal")
    fields = "block bigint, codes string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, ends array<bigint>, is_last boolean"
    costed = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(
        _folded(fields, (*names, "inner"), dict, backward, lambda c, s: ()), f"conv {conv_type}, {fields}"
    )
    costed = materialise(costed, "costed")

    # Forwards: each block's audit, from the state it is entered in.
    def forward(state: dict, row: tuple) -> Iterator[tuple]:
        conv, number, codes, blank, duplicate, truncated, illegal, ends, is_last = row
        here, block_rows = state.get("state", BEGIN), _unpack(codes)
        cost, audit, way, end = min(
            (found[0] + ends[b], found[1], found[0], to)
            for b, to in enumerate(STATES)
            if ends[b] != _NO_WAY and (found := best_between(block_rows, here, to, is_last)) is not None
        )
        before = state.get("initial")
        crossing = int(before is not None and _illegal(before, codes[0].strip()))
        state.update(state=end, initial=codes[-2].strip())
        yield conv, number, blank, duplicate, truncated, illegal + crossing, way, audit, here

    fields = "block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, entered string"
    chosen = costed.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(
        _folded(fields, (*names, "ends", "is_last"), dict, forward, lambda c, s: ()), f"conv {conv_type}, {fields}"
    )
    chosen = materialise(chosen, "chosen")

    # The repaired rows of each block, then one stream a conversation through the digest.
    def spoken(state: dict, row: tuple) -> Iterator[tuple]:
        if state.get("block") != row[1]:
            yield from spoken_end(row[0], state)
            state.clear()
            state.update(block=row[1], audit=row[2], entered=row[3], said=[])
        state["said"].append((row[4], row[5]))

    def spoken_end(conv, state: dict) -> Iterator[tuple]:
        if not state:
            return
        said = state["said"]
        initials = [(r[:1], False, False) for r, _ in said]
        for place, (at, role, _) in enumerate(leaves(initials, state["audit"], state["entered"])):
            old, text = ("", "") if at is None else said[at]
            yield conv, state["block"], place, f"{old if role is None else role}:{text}"

    with_audit = marked.withColumnRenamed("conv", "c").withColumnRenamed("block", "b").join(
        chosen.select("conv", "block", "audit", "entered"), F.col("c").eqNullSafe(F.col("conv")) & (F.col("b") == F.col("block"))
    )
    fields = "block bigint, place bigint, line string"
    lines = with_audit.select("conv", "block", "at", "audit", "entered", "role", "text").repartition("conv", "block").sortWithinPartitions("conv", "block", "at").mapInArrow(
        _folded(fields, ("conv", "block", "audit", "entered", "role", "text"), dict, spoken, spoken_end), f"conv {conv_type}, {fields}"
    )

    def digested(state: dict, row: tuple) -> Iterator[tuple]:
        if state:
            state["sha"].update(b"\n")
        state.setdefault("sha", hashlib.sha256()).update(row[1].encode())
        return iter(())

    digests = lines.repartition("conv").sortWithinPartitions("conv", "block", "place").select("conv", "line").mapInArrow(
        _folded("repaired_sha256 string", ("conv", "line"), dict, digested, lambda c, s: [(c, s["sha"].hexdigest())]),
        f"conv {conv_type}, repaired_sha256 string",
    )

    # Counts of a conversation, and its audit in order of the blocks.
    gaps = there.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    sums = chosen.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in (*FAULTS, "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"),
    )
    out = all_convs
    for part in (gaps, sums, digests):
        part = part.withColumnRenamed("conv", "c")
        out = out.join(part, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
