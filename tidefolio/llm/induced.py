"""Sorting suffixes by induction, with common-prefix values, in disk-backed queues.

Suffixes are ordered up to a depth, as far as a window of that length needs. Those that start
where the text turns from falling to rising (LMS suffixes) are sorted by their first
symbols: as the depth is bounded, this ends the recursion at its first level. All others
are induced: passing over the buckets upward, every suffix hands its falling predecessor
to the queue of that one's first symbol; passing downward likewise for rising predecessors.
A queue gets its entries in their final order, so a bucket is read from its front while it
still grows. An entry carries how many symbols it shares with the entry before it: one
more than the least value passed since, capped at the depth.

Batches are numpy arrays; queued entries beyond ``memory`` lie in an unlinked scratch file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SYMBOLS = 257  # 0 separates, byte b is b + 1
PER_WORD = 7  # nine-bit symbols in a 63-bit word


class Queues:
    """A first-in first-out queue of (place, shared) for each symbol."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts: list[list] = [[] for _ in range(SYMBOLS)]
        self.file, self.end = None, 0

    def put(self, symbol: int, place: np.ndarray, shared: np.ndarray) -> None:
        self.parts[symbol].append((place, shared))
        self.held += len(place)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    self.file.seek(self.end)
                    self.file.write(part[0].tobytes() + part[1].tobytes())
                    parts[i] = (self.end, len(part[0]))
                    self.end += 9 * len(part[0])
        self.held = 0

    def _load(self, part):
        if isinstance(part[0], np.ndarray):
            self.held -= len(part[0])
            return part
        at, n = part
        self.file.seek(at)
        raw = self.file.read(9 * n)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)

    def take(self, symbol: int):
        """Everything queued under a symbol, or None."""
        parts, self.parts[symbol] = self.parts[symbol], []
        if not parts:
            return None
        parts = [self._load(p) for p in parts]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if len(parts) > 1 else parts[0]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """A text of symbols that ends with a separator, and what induction asks of it."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, self.depth, n = symbols, depth, len(symbols)
        change = np.flatnonzero(symbols[:-1] != symbols[1:])
        following = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)] if len(change) else np.zeros(n, int)
        rising = symbols[following] < symbols[np.minimum(following + 1, n - 1)]
        self.run = np.minimum(np.maximum(following - np.arange(n) + 1, 1), depth).astype(np.uint8)
        rising[n - 1], self.run[n - 1] = True, 1
        self.rising = rising
        self.turns = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1

    def sorted_turns(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS places in order up to the depth, and what each shares with the one before."""
        padded = np.concatenate([self.symbols, np.zeros(self.depth + 2 * PER_WORD, np.uint16)]).astype(np.uint64)
        n = len(self.symbols) + self.depth + PER_WORD
        words = np.zeros(n, np.uint64)
        for k in range(PER_WORD):
            words = (words << np.uint64(9)) | padded[k:k + n]
        keys = [words[self.turns + PER_WORD * j] for j in range(-(-self.depth // PER_WORD))]
        order = np.argsort(keys[0], kind="stable")
        differs = keys[0][order]
        new = np.concatenate([[True], differs[1:] != differs[:-1]])
        for key in keys[1:]:  # only those that are equal so far go on
            tied = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(tied):
                break
            rows, group = order[tied], np.cumsum(new)[tied]
            rows = rows[np.lexsort((key[rows], group))]
            order[tied] = rows
            value = key[rows]
            new[tied[1:]] |= value[1:] != value[:-1]
        shared, alive = np.zeros(len(order), np.int64), np.arange(1, len(order))
        for key in keys:
            bits = key[order[alive]] ^ key[order[alive - 1]]
            ends = bits != 0
            shared[alive[~ends]] += PER_WORD
            at, bits = alive[ends], bits[ends]
            for k in range(1, PER_WORD):
                shared[at] += bits >> np.uint64(9 * (PER_WORD - k)) == 0
            alive = alive[~ends]
        return self.turns[order], np.minimum(shared, self.depth).astype(np.uint8)


class _Passing:
    """One pass: hands predecessors on, and knows the least shared value since each queue's last entry."""

    def __init__(self, text: Text, queues: Queues, rising: bool):
        self.text, self.queues, self.wanted = text, queues, rising
        self.least = np.full(SYMBOLS, text.depth, np.uint8)
        self.begun = np.zeros(SYMBOLS, bool)

    def over(self, place: np.ndarray, shared: np.ndarray) -> None:
        text, n = self.text, len(place)
        before = place - 1
        source = np.flatnonzero((place > 0) & (text.rising[before] == self.wanted))
        whole = shared.min()
        if not len(source):
            self.least = np.minimum(self.least, whole)
            return
        target = text.symbols[before[source]]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        # least shared value over (source of the entry before, own source]
        table = [shared]
        while (1 << len(table)) <= n:
            last, step = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[:len(last) - step], last[step:]))
        low = np.concatenate([[0], source[:-1] + 1])
        low[first] = 0
        level = np.frexp((source - low + 1).astype(np.float64))[1] - 1
        value = np.empty(len(source), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            value[at] = np.minimum(table[k][low[at]], table[k][source[at] - (1 << k) + 1])
        starts = np.flatnonzero(first)
        symbols = target[starts]
        value[starts] = np.minimum(value[starts], self.least[symbols])
        value = np.minimum(value + 1, text.depth).astype(np.uint8)
        value[starts[~self.begun[symbols]]] = 0
        self.begun[symbols] = True
        ends = np.append(starts[1:], len(source))
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.uint8(text.depth))
        self.least = np.minimum(self.least, whole)
        self.least[symbols] = after[source[ends - 1] + 1]
        for symbol, a, b in zip(symbols.tolist(), starts.tolist(), ends.tolist()):
            self.queues.put(symbol, before[source[a:b]], value[a:b])


def sorted_buckets(symbols: np.ndarray, depth: int, memory: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of suffixes, largest first symbol first, each in ascending order with shared values.

    Separators' own suffixes are left out.
    """
    text = Text(symbols, depth)
    turns, shared = text.sorted_turns()
    edges = np.searchsorted(symbols[turns], np.arange(SYMBOLS + 1))
    falling, growing, kept = Queues(memory), Queues(memory), Queues(memory)
    up = _Passing(text, falling, False)
    for c in range(SYMBOLS):
        last = None
        while (got := falling.take(c)) is not None:
            kept.put(c, *got)
            up.over(*got)
            last = got[0][-1]
        a, b = edges[c], edges[c + 1]
        if a < b:
            own = shared[a:b].copy()
            own[0] = 0 if last is None else min(text.run[last], text.run[turns[a]])
            up.over(turns[a:b], own)
    down = _Passing(text, growing, True)
    for c in range(SYMBOLS - 1, 0, -1):
        parts = []
        while (got := growing.take(c)) is not None:
            parts.append(got)
            down.over(*got)
        low = kept.take(c)
        places, values = [], []
        if low is not None:
            places.append(low[0])
            values.append(low[1])
        if parts:
            place, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            border = 0 if low is None else min(text.run[low[0][-1]], text.run[place[-1]])
            places.append(place[::-1])
            values.append(np.concatenate([[border], value[:0:-1]]).astype(np.uint8))
        if low is not None:
            backward = np.concatenate([[0 if not parts else border], low[1][:0:-1]]).astype(np.uint8)
            down.over(low[0][::-1], backward)
        if places:
            yield np.concatenate(places), np.concatenate(values)
    for q in (falling, growing, kept):
        q.close()
