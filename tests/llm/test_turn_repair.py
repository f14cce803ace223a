import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import corpora
import pytest
from loomset.llm import turn_repair as tr

TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, cost int, block string, at int, audit string"
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """Least (cost, audit) by best-first search over the edits, without an alignment table."""
    follows = {"0": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in "0a":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        nexts = []
        for letter in follows[state].replace("s", ""):
            nexts.append((3, "I", i, letter))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            nexts.append((4, "D", i + 1, state))
            if not gone:
                extra = 3 if truncated else 0
                if initial and initial in follows[state]:
                    nexts.append((extra, "K", i + 1, initial))
                nexts += [(extra + 3, "R", i + 1, letter) for letter in follows[state].replace("s", "") if letter != initial]
        for c, letter, at, to in nexts:
            heapq.heappush(heap, (cost + c, audit + letter, at, to))


def repaired(rows):
    """The contract, one conversation after another."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, coded, faults = set(), [], [0, 0, 0]
        for _, role, text in turns:
            inner = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            coded.append((role[:1], fault in (0, 1), fault == 2))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = cheapest(coded)
        lines, i, state = [], 0, "0"
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            turn = "u" if state in "0sa" else "a"
            name = {"u": "user", "a": "assistant"}[turn]
            if letter == "K":
                turn, name = coded[i][0], turns[i][1]
            lines.append(f"{name}:{'' if letter == 'I' else turns[i][2]}")
            i += letter != "I"
            state = turn
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, audit, digest))
    return sorted(out, key=str)


def chats(seed, n=150, most=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, most)):
            role = rng.choice(["system", "user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = rng.choice(["", "tool", None, "User", "s", "unknown", "amy"]) if rng.random() < 0.1 else role
            text = rng.choice([None, "", " \t\n", "no stop", "Same.", "Stop! \n", "dots... ,", "é\xa0."]) if rng.random() < 0.3 else corpora.prose(rng, 5) + "."
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 7]), role, text))
    rows += [rows[5], rows[5], rows[9], (None, 1, "user", "Hi."), (None, None, None, None), (None, 3, "assistant", "Ho."), (900, None, "user", "A."), (900, None, "assistant", "B.")]
    rows += [(901, 1, "user", "very long. " * 50_000), (901, 2, "assistant", "x" * 200_000)]
    lost = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "Gone.")]


def table(rows, data):
    return rows([(c, t, r, x, "clash", 9, "b", 8, "KKK") for c, t, r, x in data], TURNS)


def result(rows, data, **options):
    return sorted((tuple(r) for r in tr.repair(table(rows, data), **options).collect()), key=str)


def test_repairs_are_those_of_a_search_over_edits(rows):
    data = chats(1)
    got = result(rows, data)
    assert got == repaired(data)
    assert (next(c for c, *_ in got if c is not None and c >= 1000), 0, 0, 0, 0, 0, 0, "", NOTHING) in got
    assert result(rows, []) == []
    assert tr.repair(table(rows, data)).columns == ["conv_id", "gaps", *tr.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_alignment_against_a_search_over_edits(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = tuple((rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 12)))
        rows = tuple((i, gone, cut and not gone) for i, gone, cut in rows)
        assert tr.best_audit(rows) == cheapest(rows)


def test_bands_drop_no_cheapest_alignment():
    rng = random.Random(8)
    for _ in range(100):
        rows = tuple((rng.choice("sua"), rng.random() < 0.3, False) for _ in range(rng.randrange(1, 9)))
        for state in tr.STATES:
            for end in tr.STATES:
                for open_end in (False, True):
                    wide = tr.align(rows, state, end, 10_000, open_end)
                    assert tr.best_between(rows, state, end, open_end) == wide
                    if wide is not None:
                        assert tr.align(rows, state, end, wide[0], open_end) == wide
                        assert wide[0] == 0 or tr.align(rows, state, end, wide[0] - 1, open_end) is None


def test_alignments_of_hundreds_of_rows():
    rng = random.Random(9)
    for n in (100, 400):
        rows = tuple((rng.choice(["s", "u", "a"]) if rng.random() < 0.3 else "ua"[i % 2], rng.random() < 0.1, False) for i in range(n))
        assert tr.best_audit(rows) == cheapest(rows)


def test_long_conversations_go_in_blocks_to_the_same_result(rows):
    rng = random.Random(2)
    data = chats(2, 40)
    for conv, n in ((2000, 700), (2001, 97), (2002, 32), (2003, 33)):
        for turn in range(n):
            role = rng.choice(["system", "user", "assistant", "tool", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            data.append((conv, turn // 2 if conv == 2001 else turn, role, rng.choice(["", "Yes.", "no"]) if rng.random() < 0.2 else f"Turn {turn}."))
    data += [(2004, 5, "user", "All the same.")] * 200 + [(2005, None, None, None)] * 100
    assert result(rows, data, long_rows=20) == repaired(data)
    some = [d for d in data if d[0] != 2000]
    assert result(rows, some, long_rows=0) == result(rows, some)
