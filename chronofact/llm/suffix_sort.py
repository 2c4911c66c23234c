"""External suffix sorting by recursive induction, with common-prefix values carried along.

Suffixes are of type S or L, smaller or larger than their right neighbour. The order of
the leftmost S suffixes induces that of all L suffixes in one ascending sweep over the
first symbols, and these that of all S suffixes in a descending one. Tuples (place, length
of the prefix in common with the tuple before) wait in a priority queue by first symbol.
Those of one symbol arrive in their order already, so the queue keeps runs for each block
of symbols; what exceeds its memory goes to disk. The common prefix of two induced suffixes
is one longer than the least of the values between the suffixes that they come from.

The leftmost S suffixes are named by their substrings, which are sorted by their symbols
and types, and sorted by recursion on the names until all names differ; no hash decides
anything. Texts and orders that exceed the memory lie in mapped files, so a shard can be
larger than it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queued tuples in memory, and of each text or order; what comes beyond lies in unlinked files of the task.
MEMORY = 4 << 20
#: Occurrences of the symbols that a sweep takes together; a symbol with more is taken by itself.
TOGETHER = 1 << 14
#: Symbols in a row within one block up to which they are ordered together; beyond it the block is halved.
DEPTH = 16


def _hold(x: np.ndarray, memory: int) -> np.ndarray:
    """The array itself, or a copy of it in a mapped file if it is larger than `memory`."""
    if x.nbytes <= memory:
        return x
    file = tempfile.TemporaryFile()
    x.tofile(file)
    file.flush()
    return np.memmap(file, x.dtype, "r+", shape=x.shape)


class Queue:
    """Tuples (place, common prefix) by the first symbol of their block, in the order of their arrival."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file, self.spills = memory, 0, None, 0
        self.runs: dict[int, list] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}

    def push(self, block: int, run: np.ndarray) -> None:
        """run: two rows, places and values."""
        self.runs.setdefault(block, []).append(run)
        self.held += run.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """The blocks that are due last go to disk until half of the memory is free."""
        self.file = self.file or tempfile.TemporaryFile()
        for block in sorted(self.runs, reverse=True):
            if 2 * self.held <= self.memory:
                break
            run = np.concatenate(self.runs.pop(block), axis=1)
            at = self.file.seek(0, 2)
            self.file.write(run.tobytes())
            self.spilled.setdefault(block, []).append((at, run.shape[1]))
            self.held -= run.nbytes
            self.spills += 1

    def take(self, block: int) -> np.ndarray:
        out = []
        for at, n in self.spilled.pop(block, []):
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(8 * n), np.int32).reshape(2, n))
        for run in self.runs.pop(block, []):
            self.held -= run.nbytes
            out.append(run)
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int32)


class _Least:
    """Minima of stretches of an array, by those of all stretches whose length is a power of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least of x[i + 1 : j + 1], for i < j."""
        size = j - i
        level = np.frexp(size)[1] - 1
        for k in range(len(self.levels), int(level.max(initial=0)) + 1):
            below, half = self.levels[-1], 1 << (k - 1)
            self.levels.append(np.minimum(below[: len(below) - half], below[half:]))
        out = np.empty(len(size), np.int32)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            a, b = i[own] + 1, j[own] + 1 - (1 << k)
            out[own] = np.minimum(self.levels[k][a], self.levels[k][b])
        return out


def _common(text: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at p and q have in common, compared one after the other."""
    out, left, k = np.zeros(len(p), np.int32), np.arange(len(p)), 0
    while len(left):
        left = left[text[p[left] + k] == text[q[left] + k]]
        k += 1
        out[left] = k
    return out


class _Sweep:
    """One ascending sweep: from the suffixes `seeds`, in order, to those of the type `wanted` to the left of them.

    Values are common prefixes with the suffix before of the same first symbol (0 for the
    first one).
    """

    def __init__(self, text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, values: np.ndarray, symbols: int, memory: int):
        self.text, self.seeds, self.values = text, seeds, values
        #: Twice the symbol, and one more where the type is wanted.
        self.code = text * text.dtype.type(2) + wanted
        self.code[-1] = 0
        self.code = _hold(self.code, memory)
        self.queue = Queue(memory)
        count = np.cumsum(np.bincount(text, minlength=symbols))
        self.cuts, at = [0], 0
        while at < symbols:  # symbols go together up to TOGETHER occurrences
            done = count[at - 1] if at else 0
            at = max(at + 1, int(np.searchsorted(count, done + TOGETHER, side="right")))
            self.cuts.append(at)
        self.seed_cuts = np.searchsorted(text[seeds], np.arange(symbols + 1)) if symbols < len(seeds) else None
        self.seed_symbols = text[seeds] if self.seed_cuts is None else None

    def _seeds_of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.seed_symbols, [lo, hi]) if self.seed_cuts is None else (self.seed_cuts[lo], self.seed_cuts[hi])
        return np.asarray(self.seeds[a:b]), np.asarray(self.values[a:b])

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, values, whether a seed) block by block; within a symbol seeds come last."""
        blocks = list(zip(self.cuts[:-1], self.cuts[1:], strict=True))[::-1]
        while blocks:
            lo, hi = blocks.pop()
            arrived = self.queue.take(lo)
            seeds, seed_values = self._seeds_of(lo, hi)
            if not arrived.shape[1] and not len(seeds):
                continue
            whole = self._one(lo, arrived, seeds, seed_values) if hi == lo + 1 else self._many(lo, hi, arrived, seeds, seed_values)
            if whole is None:  # too deep: in two halves
                mid = (lo + hi) // 2
                blocks += [(mid, hi), (lo, mid)]
                self.cuts.insert(self.cuts.index(hi), mid)
                own = self.text[arrived[0]] < mid
                for start, run in ((lo, arrived[:, own]), (mid, arrived[:, ~own])):
                    if run.shape[1]:
                        self.queue.push(start, run)
                continue
            yield whole
            self._send(hi, *whole[:2])

    def _left(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, place, symbol) of the left neighbours that are wanted."""
        code = self.code[places - 1]  # of the first place's left neighbour the end mark's, whose type is set to unwanted
        index = np.flatnonzero(code & 1)
        return index, places[index] - 1, code[index] >> 1

    def _send(self, hi: int, places: np.ndarray, values: np.ndarray) -> None:
        """Left neighbours with a symbol from `hi` on to their queues, each symbol's in the given order."""
        index, left, symbol = self._left(places)
        far = symbol >= hi
        index, left, symbol = index[far], left[far], symbol[far]
        if not len(left):
            return
        by = np.argsort(symbol, kind="stable")
        index, symbol = index[by], symbol[by]
        run = np.ones((2, len(by)), np.int32)
        run[0] = left[by]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        run[1, same] = 1 + _Least(values).between(index[same - 1], index[same])
        ends = np.searchsorted(symbol, self.cuts)
        for start, a, b in zip(self.cuts[:-1], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a < b:
                self.queue.push(start, run[:, a:b])

    def _one(self, symbol: int, arrived: np.ndarray, seeds: np.ndarray, seed_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A single symbol: those that follow it come after it, run by run."""
        parts, depth = [arrived], 0
        while parts[-1].shape[1]:
            index, left, its = self._left(parts[-1][0])
            own = its == symbol
            index, left, depth = index[own], left[own], depth + 1
            if not len(left):
                break
            run = np.full((2, len(left)), depth, np.int32)
            run[0] = left
            if len(left) > 1:
                run[1, 1:] = 1 + _Least(parts[-1][1]).between(index[:-1], index[1:])
            parts.append(run)
        places, values = np.concatenate(parts, axis=1)
        n = len(places)
        places, values = np.concatenate([places, seeds]), np.concatenate([values, seed_values])
        if n and len(seeds):
            values[n : n + 1] = _common(self.text, places[n - 1 : n], places[n : n + 1])
        values[:1] = 0
        return places, values, np.arange(len(places)) >= n

    def _many(self, lo: int, hi: int, arrived: np.ndarray, seeds: np.ndarray, seed_values: np.ndarray) -> tuple | None:
        """Several symbols: of each what arrived, then what is induced from within the block, then seeds."""
        first = self.text[arrived[0]]
        by = np.argsort(first, kind="stable")
        arrived = arrived[:, by]
        key = np.concatenate([3 * first[by].astype(np.int64), 3 * self.text[seeds].astype(np.int64) + 2])
        by = np.argsort(key, kind="stable")
        key, places, values = key[by], np.concatenate([arrived[0], seeds])[by], np.concatenate([arrived[1], seed_values])[by]
        base_key, base_places, base_values = key, places, values
        # What the block induces within itself, step by step from what is known.
        found, source, steps = [], [], []
        index, left, symbol = self._left(places)
        origin, depth = index, 1
        while True:
            own = (symbol >= lo) & (symbol < hi)
            if not own.any():
                break
            if depth > DEPTH:
                return None
            found.append(left[own])
            source.append(origin[own])
            steps.append(np.full(len(found[-1]), depth))
            index, left, symbol = self._left(found[-1])
            origin, depth = source[-1][index], depth + 1
        if found:
            place, origin, steps = np.concatenate(found), np.concatenate(source), np.concatenate(steps)
            # Symbols up to the known suffix, that one's key, its rank: chains in the order of suffixes.
            chain = np.full((depth + 1, len(place)), -1, np.int64)
            for k in range(depth):
                inner = steps > k
                chain[k, inner] = 3 * self.text[place[inner] + k].astype(np.int64) + 1
            at = np.arange(len(place))
            chain[steps, at] = base_key[origin]
            chain[steps + 1, at] = origin
            by = np.lexsort(chain[::-1])
            place, chain, origin, steps = place[by], chain[:, by], origin[by], steps[by]
            new = np.ones(len(place), np.int32)
            if len(place) > 1:
                new[1:] = self._chained(chain, place, origin, steps, base_values)
            key = np.concatenate([base_key, chain[0]])
            by = np.argsort(key, kind="stable")
            key, places, values = key[by], np.concatenate([base_places, place])[by], np.concatenate([base_values, new])[by]
        border = np.flatnonzero(key[1:] != key[:-1]) + 1
        values[border] = 0
        within = border[key[border] // 3 == key[border - 1] // 3]
        values[within] = _common(self.text, places[within - 1], places[within])
        values[:1] = 0
        return places, values, key % 3 == 2

    def _chained(self, chain: np.ndarray, place: np.ndarray, origin: np.ndarray, steps: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours among what a block has induced within itself."""
        differs = (chain[:, 1:] != chain[:, :-1]).argmax(0)
        out = differs.astype(np.int32)
        pair = np.arange(len(differs))
        a, b = chain[differs, pair], chain[differs, pair + 1]
        # The rank is what differs: both have come to known suffixes of one kind and symbol.
        known = differs == steps[1:] + 1
        known &= differs == steps[:-1] + 1
        if known.any():
            i = np.flatnonzero(known)
            out[i] += _Least(base).between(origin[i], origin[i + 1]) - 1
        seam = np.flatnonzero(~known & (a // 3 == b // 3))
        out[seam] += _common(self.text, place[seam] + differs[seam], place[seam + 1] + differs[seam])
        return out


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the end mark is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change] < text[change + 1], True)
    return np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, values: np.ndarray, symbols: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of all suffixes but the end mark's, in descending order, block by block."""
    kept = [(p[~s], v[~s]) for p, v, s in _Sweep(text, ~small, seeds, values, symbols, memory).run()]
    places, common = (np.concatenate(c)[::-1] for c in zip(*kept, strict=True))
    del kept
    places, common = _hold(places, memory), _hold(np.append(np.zeros(1, np.int32), common[:-1]), memory)  # with the one before in descending order
    mirrored = _hold((symbols - 1 - text).astype(text.dtype), memory)
    for p, v, _ in _Sweep(mirrored, small, places, common, symbols, memory).run():
        yield p, v


def _substrings(text: np.ndarray, small: np.ndarray, starts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether it is the one before again) of the substrings from each start to the next one, both included.

    They are compared by symbol and, of equal symbols, type (L before S): as many at once
    as a word holds, then the next ones of those that are equal so far.
    """
    size = np.append(np.diff(starts) + 1, 1)
    bits = (2 * symbols - 1).bit_length()
    at_once, end = 63 // bits, len(text) - 1

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        out, p, left = np.zeros(len(which), np.int64), starts[which] + depth, size[which] - depth
        for j in range(at_once):
            at = np.minimum(p + j, end)
            out = (out << bits) | np.where(left > j, 2 * text[at].astype(np.int64) + small[at], 0)
        return out

    keys = key(np.arange(len(starts)), 0)
    order = np.argsort(keys, kind="stable")
    head = np.append(True, keys[order[1:]] != keys[order[:-1]])
    depth = at_once
    while True:
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone & (size[order] > depth))
        if not len(at):
            return order, ~head
        group = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))[at]
        keys = key(order[at], depth)
        by = np.lexsort((keys, group))
        order[at], keys = order[at[by]], keys[by]
        head[at[1:]] |= keys[1:] != keys[:-1]
        depth += at_once


def suffixes(text: np.ndarray, symbols: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the suffix before it) of all suffixes in descending order, block by block.

    The text ends with its only, smallest symbol 0, whose suffix comes last.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.int32)
        return
    text, small = _hold(text, memory), _hold(_types(text), memory)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    m = len(leftmost)
    ranked, same = _substrings(text, small, leftmost, symbols)
    names = np.cumsum(~same) - 1
    distinct, common = int(names[-1]) + 1, np.zeros(m, np.int32)
    if distinct == m:
        order = leftmost[ranked]
        common[1:] = _common(text, order[:-1], order[1:])
    else:
        reduced = np.empty(m, np.int32)
        reduced[ranked] = names
        parts = list(suffixes(reduced, distinct, memory))
        at, equal = (np.concatenate(c)[::-1] for c in zip(*parts, strict=True))
        equal = np.append(np.zeros(1, np.int32), equal[:-1])
        # As many names, then what the suffixes at the first different names have in common.
        i, j = leftmost[at[:-1] + equal[1:]], leftmost[at[1:] + equal[1:]]
        order = leftmost[at]
        common[1:] = i - order[:-1] + _common(text, i, j)
        del reduced, parts
    del ranked, names
    yield from _induce(text, small, _hold(order, memory), _hold(common, memory), symbols, memory)
    yield np.array([n - 1], np.int32), np.zeros(1, np.int32)


def suffix_order(text: np.ndarray, symbols: int, memory: int = MEMORY) -> np.ndarray:
    """Places of all suffixes in ascending order."""
    return np.concatenate([p for p, _ in suffixes(text, symbols, memory)])[::-1]


def prefix_values(text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the value of text[i:j] is (sums[j] - sums[i]) * inverse[i], modulo 2**64."""
    n = len(text)
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums, inverse


def repeated_starts(strings: list[bytes], width: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each string, whether the `width` bytes from each place on also start at another place of any string.

    All strings go into one text, parted by a mark, and its suffixes are sorted; places
    with a common prefix of `width` bytes or more stand next to each other.
    """
    size = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16) + np.int16(2)
    text[starts + size] = 1
    text = np.append(text, np.int16(0))
    again, before = np.zeros(len(text), bool), None
    for places, common in suffixes(text, 258, memory):
        long = np.flatnonzero(common >= width)
        again[places[long]] = True
        again[places[long[long > 0] - 1]] = True
        if len(long) and long[0] == 0:
            again[before] = True
        before = places[-1]
    # A mark lies within the common prefix of suffixes that begin fewer than `width` bytes before it.
    return [again[lo : lo + max(0, n - width + 1)] for lo, n in zip(starts.tolist(), size.tolist(), strict=True)]
