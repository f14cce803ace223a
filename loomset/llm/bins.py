"""Bin completion over counts of sizes.

There are at most ``capacity`` sizes however many pieces have them, so that a plan is made from
their counts alone, by branch and bound from its first bin to its last: around the largest size
left, undominated fillings are enumerated, the fullest first, each used as often as the counts
allow, half as often, or once. A branch ends where the room left empty exceeds what the aimed-at
number of bins can spare. Best-fit decreasing is the incumbent throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

NODES = 8_000  # fillings looked at beyond one pass per aim before the incumbent stands
LIVE = 16  # choices of a search, the last ones, whose fillings are held at once: each may take 700 kB, and there are thousands


END = object()  # of an iterator


class Pattern(NamedTuple):
    """``times`` bins that each hold ``sizes`` (descending, with repeats)."""

    sizes: tuple[int, ...]
    times: int


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: total size, or the pieces above half, whose waste small pieces can only partly fill."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    large = sorted(s for s, n in counts.items() if n and 2 * s > capacity)
    bins = sum(counts[s] for s in large)
    # For each threshold t: pieces above capacity - t stand alone, those of t and more share the rest.
    for t in {s for s in counts if counts[s] and 2 * s <= capacity}:
        alone = sum(counts[s] for s in large if s > capacity - t)
        room = sum((capacity - s) * counts[s] for s in large if s <= capacity - t)
        middle = sum(s * n for s, n in counts.items() if t <= s and 2 * s <= capacity)
        best = max(best, bins + max(0, -(-(middle - room) // capacity)), alone)
    return max(best, bins)


def _reach(counts: list[int], sizes: list[int], room: int) -> list[int]:
    """Bit sets: entry i has the sums up to ``room`` of pieces from ``sizes[i:]`` (descending)."""
    mask = (1 << (room + 1)) - 1
    sums = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        s, n, bits = sizes[i], min(counts[sizes[i]], room // sizes[i]), sums[i + 1]
        step = 1
        while n:  # binary splitting of n equal pieces
            take = min(step, n)
            bits |= (bits << (take * s)) & mask
            n -= take
            step *= 2
        sums[i] = bits
    return sums


def _made(counts: list[int], sizes: list[int], sums: list[int], i: int, left: int) -> Iterator[tuple[int, ...]]:
    """All ways to make up ``left`` from ``sizes[i:]``, larger pieces first; each look finds one."""
    if not left:  # no closure: one that calls itself would keep the sums until Python collects its garbage
        yield ()
        return
    while i < len(sizes) and sums[i] >> left & 1:
        s = sizes[i]
        for k in range(min(counts[s], left // s), 0, -1):
            if sums[i + 1] >> (left - k * s) & 1:
                for rest in _made(counts, sizes, sums, i + 1, left - k * s):
                    yield (s,) * k + rest
        i += 1


def fillings(counts: list[int], room: int, least: int = 0) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of ``room`` with a total of ``least`` or more, the fullest first, then those of larger pieces.

    An exact single piece dominates all others, and is the only one given; an exact pair comes
    before other full fillings, and without a look at the rest. None stands for a dominated one.
    """
    if room and counts[room]:
        yield (room,)
        return
    given: list[tuple[int, ...]] = []
    for a in range(room - 1, (room - 1) // 2, -1):
        if counts[a] and counts[room - a] >= (2 if 2 * a == room else 1):
            given.append((a, room - a))
            yield given[0]
            break
    sizes = [s for s in range(room, 0, -1) if counts[s]]
    sums = _reach(counts, sizes, room)

    top = sums[0] >> least << least
    while top:
        total = top.bit_length() - 1
        top ^= 1 << total
        for chosen in _made(counts, sizes, sums, 0, total):
            if any(_dominates(other, chosen) for other in given):
                yield None
            else:
                given.append(chosen)
                yield chosen


def least_waste(counts: list[int], capacity: int) -> int:
    """A lower bound on empty room: what all small pieces together cannot fill of the bins that large ones open."""
    waste = spare = fits = 0
    for s in range(capacity, capacity // 2, -1):
        if counts[s]:
            while fits < capacity - s:
                fits += 1
                spare += fits * counts[fits]
            spare -= (capacity - s) * counts[s]
            waste += max(0, -spare)
            spare = max(0, spare)
    return waste


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be dealt onto those of ``a``, each at most full (greedily)."""
    rooms = sorted(a)
    for piece in sorted(b, reverse=True):
        fit = next((i for i, r in enumerate(rooms) if r >= piece), None)
        if fit is None:
            return False
        rooms[fit] -= piece
        rooms.sort()
    return True


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: pieces of one size go to the fullest bins that take them."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[Pattern] = []
    for s in range(capacity, 0, -1):
        left = counts[s]
        while left:
            room = next((r for r in sorted(open_bins) if r >= s), None)
            if room is None:
                held, n, room = (), left, capacity
            else:
                held, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            fit = min(room // s, left)
            use = min(n, left // fit)
            if n > use:
                open_bins.setdefault(room, []).append((held, n - use))
            left -= use * fit
            rest = room - fit * s
            if rest:
                open_bins.setdefault(rest, []).append((held + (s,) * fit, use))
            else:
                done.append(Pattern(held + (s,) * fit, use))
    return done + [Pattern(h, n) for bins in open_bins.values() for h, n in bins]


def _options(counts: list[int], capacity: int, largest: int, room_left: int, barred: tuple[int, ...]) -> Iterator[Pattern | None]:
    """Bins around a piece of size ``largest`` that together leave at most ``room_left`` empty."""
    held = counts.copy()
    held[largest] -= 1
    for filling in fillings(held, capacity - largest, max(0, capacity - largest - room_left)):
        sizes = (largest, *(filling or ()))
        if filling is None or sizes == barred:
            yield None
            continue
        waste = capacity - sum(sizes)
        times = min(counts[s] // sizes.count(s) for s in set(sizes))
        if waste:
            times = min(times, room_left // waste)
        yield from (Pattern(sizes, t) for t in sorted({times, (times + 1) // 2, 1}, reverse=True))


class _Choice:
    """A bin to be filled: its largest piece, and how many of its options have been seen."""

    def __init__(self, largest: int, barred: tuple[int, ...]):
        self.largest, self.barred, self.seen = largest, barred, 0
        self.options: Iterator[Pattern | None] | None = None


def search(counts: list[int], capacity: int, target: int, nodes: int) -> tuple[list[Pattern] | None, int]:
    """Bins for all pieces, at most ``target``, or None if none are found among ``nodes`` fillings; and how many were looked at.

    Depth first. Fewer uses of a filling than possible are followed by another filling of the
    same size, so that no set of bins is looked at in two orders. A choice further up than the
    last ``LIVE`` keeps only how many of its options have been seen, and lists them anew if the
    search comes back to it, when the counts are again what they were.
    """
    counts = counts.copy()
    room_left = target * capacity - sum(s * n for s, n in enumerate(counts))
    if room_left < least_waste(counts, capacity):
        return None, 0
    plan: list[Pattern] = []
    stack: list[_Choice] = []
    used, largest, barred = 0, capacity, ()
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return plan, used
        stack.append(_Choice(largest, barred))
        if len(stack) > LIVE:
            stack[-1 - LIVE].options = None
        while stack:
            choice = stack[-1]
            if choice.options is None:
                choice.options = islice(_options(counts, capacity, choice.largest, room_left, choice.barred), choice.seen, None)
            step = next(choice.options, END)
            if step is not END:
                choice.seen += 1
                used += 1
                if used > nodes:
                    return None, used
                if step is None:
                    continue
                for s in step.sizes:
                    counts[s] -= step.times
                room_left -= step.times * (capacity - sum(step.sizes))
                plan.append(step)
                if room_left >= least_waste(counts, capacity):
                    break
            else:
                stack.pop()
                if not stack:
                    return None, used
            undone = plan.pop()
            for s in undone.sizes:
                counts[s] += undone.times
            room_left += undone.times * (capacity - sum(undone.sizes))
        largest = plan[-1].sizes[0]
        barred = plan[-1].sizes


def complete(sizes: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold every piece once: ``sizes`` maps a size from 1 to ``capacity`` to how many have it.

    The lower bound is aimed at first, then one bin less than the incumbent, then numbers halfway
    between, until they meet. An aim may look at enough fillings for one pass over all sizes and at
    half of what is left of ``nodes``; missed for lack of these, it is taken for out of reach.
    ``gap`` tells what stays open.
    """
    counts = [0] * (capacity + 1)
    for s, n in sizes.items():
        counts[s] = n
    best = best_fit(counts, capacity)
    bins, low = sum(p.times for p in best), least_bins(sizes, capacity)
    aims = [bins - 1, low]
    one_pass = 2 * len(sizes)
    while low < bins:
        aim = min(aims.pop(), bins - 1) if aims else (low + bins) // 2
        found, used = search(counts, capacity, max(aim, low), one_pass + nodes // 2)
        nodes -= min(nodes, max(0, used - one_pass))
        if found is None:
            low = max(aim, low) + 1
        else:
            best, bins = found, sum(p.times for p in found)
    return best


def gap(plan: list[Pattern], sizes: dict[int, int], capacity: int) -> int:
    """Bins of a plan above the lower bound: 0 proves that there are no fewer."""
    return sum(p.times for p in plan) - least_bins(sizes, capacity)
