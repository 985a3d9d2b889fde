"""Order of all suffixes of a text and what neighbours share, by induced sorting in external memory.

The suffixes that are smaller than the next one but not than the one before (here: stars) are sorted first: their pieces, up
to the next star, are sorted and named by induction, and the text of names is sorted by the same function. From the stars,
one sweep upwards induces the suffixes that are larger than the next one, one sweep downwards the others. A sweep takes the
smallest suffix from a priority queue and puts in the suffix one symbol longer. The queue is made of one region for each range
of first symbols, as long as is known from a count; what is put into a region comes in the order of the rest of the suffix.
Entries carry the symbols before them, so that the text isn't looked up, and what is needed for the common prefix with the
entry before. Arrays beyond IN_MEMORY bytes are files without a name, which the system drops with the task that holds them.

All steps take blocks of the sweep that can't depend on each other: from the smallest entry up to where one of them would
put a new entry.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Longer arrays are kept on disk.
IN_MEMORY = 128 << 20
#: Texts (of names) of so many symbols are sorted in memory by doubling.
DOUBLED = 1 << 22
#: Entries processed at a time, and in a range of several symbols.
BLOCK, RANGE = 1 << 18, 1 << 12
FAR = 1 << 30

#: A suffix in a queue: its first symbol and position, how often the first symbol stands there in a row, the block of the
#: suffix it comes from (-1: given from outside), common prefix from before and to the end of that block, symbols before it.
ENTRY = np.dtype([("sym", "i8"), ("pos", "i8"), ("carry", "i8"), ("run", "i4"), ("block", "i4"), ("pre", "i4"), ("suf", "i4"), ("left", "i4")])


def array(size: int, kind) -> np.ndarray:
    """An array in memory or, if it's long, in a file of the task's own that has no name."""
    kind = np.dtype(kind)
    if size * kind.itemsize <= IN_MEMORY:
        return np.zeros(size, kind)
    folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None) as file:
        return np.memmap(file, kind, "w+", shape=(size,))


def blocks(size: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, size, BLOCK):
        yield lo, min(lo + BLOCK, size)


class RangeMin:
    """Minima of stretches of an array, which is read by blocks of 32 and whose block minima are held in memory."""

    WIDE = 32

    def __init__(self, of: np.ndarray):
        self.of = of
        padded = -(-len(of) // self.WIDE) * self.WIDE
        self.front, self.back = array(padded, "i4"), array(padded, "i4")
        least = np.full(padded // self.WIDE, FAR, np.int32)
        for lo, hi in blocks(padded):
            part = np.full((hi - lo, 1), FAR, np.int32)[:, 0]
            part[:max(0, min(hi, len(of)) - lo)] = of[lo:hi]
            part = part.reshape(-1, self.WIDE)
            self.front[lo:hi] = np.minimum.accumulate(part, axis=1).ravel()
            self.back[lo:hi] = np.minimum.accumulate(part[:, ::-1], axis=1)[:, ::-1].ravel()
            least[lo // self.WIDE:hi // self.WIDE] = part.min(axis=1)
        self.levels = _doubled(least, len(least))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the stretches from ``first`` to ``last``, both included."""
        a, b = first // self.WIDE, last // self.WIDE
        out = np.minimum(self.back[first], self.front[last])
        inner = np.flatnonzero(b - a > 1)
        if len(inner):
            out[inner] = np.minimum(out[inner], _least(self.levels, a[inner] + 1, b[inner] - 1))
        within = np.flatnonzero(a == b)
        if len(within):
            at = a[within, None] * self.WIDE + np.arange(self.WIDE)
            ok = (at >= first[within, None]) & (at <= last[within, None])
            out[within] = np.where(ok, self.of[np.minimum(at, len(self.of) - 1)], FAR).min(axis=1)
        return out


def _doubled(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of the stretches of 1, 2, 4 ... values, for stretches up to ``longest``."""
    levels, wide = [values], 1
    while 2 * wide <= longest:
        levels.append(np.minimum(levels[-1][:-wide], levels[-1][wide:]))
        wide *= 2
    return levels


def _least(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    level = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), np.int32)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << int(k)) + 1])
    return out


class _BlockMins:
    """Minima of the common prefixes of each block of a sweep so far, and of stretches of blocks."""

    def __init__(self):
        self.table, self.size = np.full((24, 1024), FAR, np.int32), 0

    def append(self, value: int) -> None:
        if self.size == self.table.shape[1]:
            self.table = np.concatenate((self.table, np.full_like(self.table, FAR)), axis=1)
        j = self.size
        self.table[0, j] = value
        for k in range(1, (j + 1).bit_length()):
            i = j - (1 << k) + 1
            self.table[k, i] = min(self.table[k - 1, i], self.table[k - 1, i + (1 << k - 1)])
        self.size += 1

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """FAR where there is no block from ``first`` to ``last``."""
        some = last >= first
        level = np.where(some, np.frexp(np.maximum(last - first + 1, 1))[1] - 1, 0)
        first = np.where(some, first, 0)
        last = np.where(some, last, 0)
        return np.where(some, np.minimum(self.table[level, first], self.table[level, last - (1 << level) + 1]), FAR)


class _Text:
    """A text of symbols below ``symbols`` that ends with the only 0, with types, runs and stars of its positions."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, self.symbols, self.size = text, symbols, len(text)
        self.bits = max(1, (symbols - 1).bit_length())
        self.held = min(6, 62 // self.bits)
        n = self.size
        rises = array(n, bool)
        self.runs = array(n, "i4")
        kind, run, right = True, 0, -1
        for lo, hi in reversed(list(blocks(n))):
            part = np.asarray(text[lo:hi]).astype(np.int64)
            after = np.append(part[1:], right)
            ends, rise = part != after, part < after
            if hi == n:
                ends[-1] = rise[-1] = True
            at = np.where(ends, np.arange(len(part)), FAR)
            at = np.minimum.accumulate(at[::-1])[::-1]
            inside = at < FAR
            stop = np.where(inside, at, 0)
            rises[lo:hi] = np.where(inside, rise[stop], kind)
            self.runs[lo:hi] = np.where(inside, stop - np.arange(len(part)) + 1, len(part) - np.arange(len(part)) + run)
            kind, run, right = bool(rises[lo]), int(self.runs[lo]), int(part[0])
        self.up, self.down, self.star_counts = (array(symbols, "i8") for _ in range(3))
        count = 0
        for lo, hi in blocks(n):
            count += len(self._stars(rises, lo, hi))
        self.stars, count = array(count, "i8"), 0
        for lo, hi in blocks(n):
            part, rise, found = np.asarray(text[lo:hi]), np.asarray(rises[lo:hi]), self._stars(rises, lo, hi)
            self.stars[count:count + len(found)] = found
            count += len(found)
            for counts, of in ((self.up, part[rise]), (self.down, part[~rise]), (self.star_counts, part[found - lo])):
                if symbols <= 1 << 16:
                    counts += np.bincount(of, minlength=symbols)
                else:
                    some, times = np.unique(of, return_counts=True)
                    counts[some] += times

    @staticmethod
    def _stars(rises: np.ndarray, lo: int, hi: int) -> np.ndarray:
        before = np.concatenate(([rises[lo - 1] if lo else True], rises[lo:hi - 1]))
        return lo + np.flatnonzero(rises[lo:hi] & ~before)

    def before(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before positions, packed, and how many; on disk, positions are looked up in order."""
        order = np.argsort(pos) if isinstance(self.text, np.memmap) else slice(None)
        at = pos[order]
        carry, left = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int32)
        for j in range(self.held):
            ok = at > j
            carry[order] |= np.where(ok, self.text[np.maximum(at - 1 - j, 0)].astype(np.int64) << (self.bits * j), 0)
            left[order] += ok
        return carry, left

    def entries(self, pos: np.ndarray, common: np.ndarray, runs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), ENTRY)
        out["pos"], out["pre"], out["run"], out["block"], out["sym"] = pos, common, runs, -1, self.text[pos]
        out["carry"], out["left"] = self.before(pos)
        return out


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The range of each symbol, the last symbol of each range and where each begins in the queue (and the last ends)."""
    ends = np.cumsum(counts)
    of = (ends - counts) // RANGE
    large = counts > RANGE  # has a range of its own
    new = np.concatenate(([True], (of[1:] != of[:-1]) | large[1:] | large[:-1]))
    of = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    return of, np.append(firsts[1:], len(counts)) - 1, np.append((ends - counts)[firsts], ends[-1])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a) + len(b), ENTRY)
    out[:len(a)], out[len(a):] = a, b
    return out


def _shifted(first: int, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[0], out[1:] = first, values[:-1]
    return out


def _sweep(text: _Text, counts: np.ndarray, given: Iterator[np.ndarray], down: bool, sink: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Induces, from the ``given`` entries in their order, all others; ``sink`` gets them all with their common prefixes.

    ``counts`` tells how many entries each symbol will have. Going down, symbols are turned round. Among entries of one
    symbol the induced ones come before the given ones.
    """
    symbols, mask = text.symbols, (1 << text.bits) - 1
    counts = counts[::-1] if down else counts
    range_of, last_symbol, starts = _ranges(counts)
    queue = array(int(starts[-1]), ENTRY)
    filled = starts[:-1].copy()
    mins, empty = _BlockMins(), np.zeros(0, ENTRY)
    waiting, given_left = empty, True
    last = np.zeros(1, ENTRY)
    last["sym"] = -1

    def fetch() -> None:
        nonlocal waiting, given_left
        while not len(waiting) and given_left:
            waiting = next(given, None)
            if waiting is None:
                waiting, given_left = empty, False

    for r, top in enumerate(last_symbol):
        single = top == 0 or range_of[top - 1] != r
        read, pending = int(starts[r]), empty
        while True:
            stop = min(int(filled[r]), read + BLOCK) if single else int(filled[r])
            if stop > read and not (single and len(pending)):
                pending = _joined(pending, queue[read:stop])
                read = stop
                if not single:
                    pending = pending[np.argsort(pending["sym"], kind="stable")]
            fetch()
            # Given entries come after all induced ones of their symbol, so that they wait for the last symbol pending.
            limit, side = (pending["sym"][-1], "left") if len(pending) else (top, "right")
            here = waiting[:BLOCK][:np.searchsorted(waiting["sym"][:BLOCK], limit, side)]
            if not len(pending) and not len(here):
                break
            if len(pending) and len(here):
                order = np.argsort(np.concatenate((pending["sym"] * 2, here["sym"] * 2 + 1)), kind="stable")
                if len(here) == min(len(waiting), BLOCK):  # of those that aren't here yet none may come before
                    order = order[:int(np.flatnonzero(order >= len(pending))[-1]) + 1]
                merged = _joined(pending, here)[order[:BLOCK]]
            else:
                merged = (pending if len(pending) else here)[:BLOCK]
            is_given, sym = merged["block"] < 0, merged["sym"]
            before = merged["carry"] & mask
            before = symbols - 1 - before if down else before
            puts = (merged["left"] > 0) & np.where(is_given, before > sym, before >= sym)
            nearest = np.minimum.accumulate(np.where(puts, before, symbols))[:-1]
            late = np.flatnonzero((sym[1:] > nearest) | (sym[1:] == nearest) & is_given[1:])
            if len(late):
                cut = int(late[0]) + 1
                merged, is_given, sym, before, puts = merged[:cut], is_given[:cut], sym[:cut], before[:cut], puts[:cut]
            taken = int(is_given.sum())
            waiting, pending = waiting[taken:], pending[len(merged) - taken:]

            pre, block = merged["pre"], merged["block"]
            was, suf, run, symbol = (_shifted(last[c][0], merged[c]) for c in ("block", "suf", "run", "sym"))
            common = np.where(is_given, np.where(was < 0, pre, np.minimum(run, merged["run"])), pre + 1)
            far = np.flatnonzero(~is_given & (was != block))
            if len(far):
                common[far] = np.minimum(np.minimum(suf[far], pre[far]), mins(was[far] + 1, block[far] - 1)) + 1
            common[symbol != sym] = 0
            last = merged[-1:].copy()
            sink(merged, common)

            at = np.flatnonzero(puts)
            to = before[at]
            at = at[np.argsort(to.astype(np.uint16) if symbols <= 1 << 16 else to, kind="stable")]
            put = np.zeros(len(at), ENTRY)
            if len(at):
                to = before[at]
                same = to[1:] == to[:-1]
                first, final = np.append(True, ~same), np.append(~same, True)
                put["pre"] = np.minimum.accumulate(common)[at]
                inner = np.flatnonzero(~first)
                if len(inner):
                    a, b = at[inner - 1] + 1, at[inner]
                    put["pre"][inner] = _least(_doubled(common, int((b - a).max()) + 1), a, b)
                behind = np.append(np.minimum.accumulate(common[::-1])[::-1][1:], FAR)
                put["suf"] = np.where(final, behind[at], 0)
                put["sym"], put["pos"], put["block"] = to, merged["pos"][at] - 1, mins.size
                put["run"] = np.where(to == sym[at], merged["run"][at] + 1, 1)
                put["carry"], put["left"] = merged["carry"][at] >> text.bits, merged["left"][at] - 1
                spent = np.flatnonzero((put["left"] == 0) & (put["pos"] > 0))
                if len(spent):
                    put["carry"][spent], put["left"][spent] = text.before(put["pos"][spent])
                region = range_of[to]
                heads = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
                sizes = np.diff(np.append(heads, len(region)))
                queue[np.arange(len(region)) + np.repeat(filled[region[heads]] - heads, sizes)] = put
                filled[region[heads]] += sizes
            mins.append(int(common.min()))


def _upwards(text: _Text, given: Iterator[np.ndarray]) -> np.ndarray:
    """Entries larger than what follows them, sorted, with their common prefixes in ``pre``."""
    out, n = array(int(text.down.sum()), ENTRY), 0

    def sink(entries: np.ndarray, common: np.ndarray) -> None:
        nonlocal n
        own = np.flatnonzero(entries["block"] >= 0)
        part = entries[own]
        part["pre"], part["block"] = common[own], -1
        out[n:n + len(own)] = part
        n += len(own)

    _sweep(text, text.down, given, False, sink)
    return out


def _reversed(text: _Text, entries: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted entries from the largest on, each with the common prefix with the next larger one."""
    larger = 0
    for lo, hi in reversed(list(blocks(len(entries)))):
        part = entries[lo:hi][::-1].copy()
        own = part["pre"].copy()
        part["pre"] = np.append(larger, own[:-1])
        larger = own[-1]
        part["sym"] = text.symbols - 1 - part["sym"]
        yield part


def _pieces(text: _Text) -> tuple[np.ndarray, np.ndarray]:
    """Stars but the last, from the one with the largest piece on, and what each piece shares with the larger one."""
    n = len(text.stars)
    of, _, starts = _ranges(text.star_counts)
    dealt, filled = array(n, "i8"), starts[:-1].copy()
    for lo, hi in blocks(n):
        stars = np.asarray(text.stars[lo:hi])
        region = of[text.text[stars]]
        order = np.argsort(region, kind="stable")
        region = region[order]
        heads = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        sizes = np.diff(np.append(heads, len(region)))
        dealt[np.arange(len(region)) + np.repeat(filled[region[heads]] - heads, sizes)] = stars[order]
        filled[region[heads]] += sizes

    def given() -> Iterator[np.ndarray]:
        for first, stop in zip(starts[:-1], starts[1:]):
            size = int(stop - first)
            for lo in range(int(first), int(stop), BLOCK if size > 2 * RANGE else max(size, 1)):
                entries = text.entries(dealt[lo:min(lo + (BLOCK if size > 2 * RANGE else size), int(stop))], 1, 1)
                yield entries[np.argsort(entries["sym"], kind="stable")]

    found, common, count, held = array(max(n - 1, 0), "i8"), array(max(n - 1, 0), "i4"), 0, 0
    mask = (1 << text.bits) - 1

    def sink(entries: np.ndarray, shared: np.ndarray) -> None:
        nonlocal count, held
        before = text.symbols - 1 - (entries["carry"] & mask)
        at = np.flatnonzero((entries["block"] >= 0) & (entries["left"] > 0) & (before < entries["sym"]))
        if not len(at):
            held = min(held, int(shared.min()))
            return
        least = np.minimum.reduceat(shared[:at[-1] + 1], np.append(0, at[:-1] + 1))
        least[0] = min(least[0], held)
        found[count:count + len(at)], common[count:count + len(at)] = entries["pos"][at], least
        count += len(at)
        held = int(shared[at[-1] + 1:].min()) if at[-1] + 1 < len(shared) else FAR

    _sweep(text, text.up, _reversed(text, _upwards(text, given())), True, sink)
    assert count == n - 1, (count, n)
    return found, common


def _sorted_stars(text: _Text) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the stars in the order of their suffixes, and what each suffix shares with the one before."""
    n = len(text.stars)
    pos, shared = _pieces(text)
    names, number, lengths = array(n, "i4"), array(n, "i8"), array(n, "i8")
    count, before = 0, -1
    for lo, hi in blocks(n - 1):
        at = np.asarray(pos[lo:hi])
        order = np.argsort(at)
        k = np.empty(len(at), np.int64)
        k[order] = np.searchsorted(text.stars, at[order])
        number[lo:hi] = k
        long = text.stars[k + 1] - at + 1
        lengths[k] = long
        new = (shared[lo:hi] < long) | (long != np.append(before, long[:-1]))
        before = long[-1]
        if lo == 0:
            new[0] = True
        down = count + np.cumsum(new) - 1
        names[k] = down
        count = int(down[-1]) + 1
    lengths[n - 1] = 1
    between = array(count + 1, "i4")  # what the pieces of a name and of the one before share
    down = -1
    for lo, hi in blocks(n - 1):
        own = np.asarray(names[number[lo:hi]])
        first = np.append(down, own[:-1]) != own
        down = int(own[-1])
        some = own[first]
        between[np.where(some > 0, count - some + 1, 0)] = shared[lo:hi][first]
    between[:2] = 0
    for lo, hi in blocks(n):
        names[lo:hi] = count - names[lo:hi]
    names[n - 1] = 0
    common = array(n, "i4")
    if count == n - 1:
        order, depth = array(n, "i8"), None
        for lo, hi in blocks(n):
            order[names[lo:hi]] = np.arange(lo, hi)
    else:
        order, depth = suffix_order(names, count + 1, True)
    least = RangeMin(between)
    for lo, hi in blocks(n):
        own = np.asarray(order[lo:hi])
        other = np.append(order[lo - 1] if lo else 0, own[:-1])
        same = np.zeros(len(own), np.int64) if depth is None else np.asarray(depth[lo:hi]).astype(np.int64)
        a, b = other + same, own + same
        x, y = names[a].astype(np.int64), names[b].astype(np.int64)
        part = least(np.minimum(x + 1, y), y).astype(np.int64)
        # One piece ends within the other: where it ends, one suffix rises and the other falls after equal symbols.
        ended = np.flatnonzero((part == lengths[a]) | (part == lengths[b]))
        if len(ended):
            step = part[ended] - 1
            p, q = text.stars[a[ended]] + step, text.stars[b[ended]] + step
            p, q = np.minimum(p, text.size - 1), np.minimum(q, text.size - 1)
            part[ended] = step + np.minimum(text.runs[p], text.runs[q])
        common[lo:hi] = text.stars[b] - text.stars[own] + part
    common[:2] = 0
    return order, common


def _doubling(symbols_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`suffix_order` in memory: ranks of prefixes of 1, 2, 4 ... symbols until all differ."""
    size = len(symbols_of)
    ranks = [np.asarray(symbols_of).astype(np.int32)]
    while True:
        wide = 1 << (len(ranks) - 1)
        key = ranks[-1].astype(np.int64) * (size + 1)
        key[:-wide] += ranks[-1][wide:]
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.append(False, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(size, np.int32)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == size - 1:
            break
        ranks.append(rank)
    common = np.zeros(size, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        # The last symbol stands once, so that equal prefixes end before it and a step stays within the text.
        same = ranks[k][a] == ranks[k][b]
        step = same.astype(np.int64) << k
        common[1:] += step.astype(np.int32)
        a += step
        b += step
    return order, common


def suffix_order(symbols_of: np.ndarray, symbols: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in their order, and the length of the prefix that each shares with the one before.

    ``symbols_of`` is a text of whole numbers below ``symbols``; it ends with the only 0 in it. ``inner`` texts, those of
    names, may be sorted by doubling if they are small.
    """
    size = len(symbols_of)
    order, common = array(size, "i8"), array(size + 1, "i4")
    if size == 1:
        return order, common[:1]
    if inner and size <= DOUBLED:
        return _doubling(symbols_of)
    text = _Text(symbols_of, symbols)
    stars, shared = _sorted_stars(text)

    def given() -> Iterator[np.ndarray]:
        for lo, hi in blocks(len(stars)):
            pos = text.stars[stars[lo:hi]]
            yield text.entries(pos, shared[lo:hi], text.runs[pos])

    at = size

    def sink(entries: np.ndarray, prefixes: np.ndarray) -> None:
        nonlocal at
        at -= len(entries)
        order[at:at + len(entries)] = entries["pos"][::-1]
        common[at + 1:at + 1 + len(entries)] = prefixes[::-1]

    falling = _upwards(text, given())
    _sweep(text, text.up, _reversed(text, falling), True, sink)
    assert at == 1, at
    order[0] = size - 1
    common[:2] = 0
    return order, common[:size]
