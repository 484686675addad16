"""Suffix sorting by external induction.

Suffixes at local minima of the text ("low" ones) are sorted first; all others follow by induction: the sorted low
suffixes give those that are greater than their successor, in ascending order, and these the rest, in descending
order. The tuples still to be handed out wait in a priority queue by first symbol, whose runs go to disk beyond a
limit of memory, and carry their common prefix with the tuple before. To sort the low suffixes, the stretches
between two low positions are sorted by the same induction and named, and the string of names by doubling.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable

import numpy as np

from .common import U, mix, powers, seeds

#: Queue entries held in memory, and the size from which the text's arrays are in files.
MEMORY_ENTRIES, MEMORY_TEXT = 32 << 20, 256 << 20
_BASE = 0xD1342543DE82EF95 | 1


def _room(n: int, kind) -> np.ndarray:
    """An array of n, in an unnamed file if it is large."""
    return np.zeros(n, dtype=kind) if n <= MEMORY_TEXT else np.memmap(tempfile.TemporaryFile(), dtype=kind, shape=(n,), mode="w+")


class Queue:
    """Runs of (position, common prefix) by symbol: push appends, take hands a symbol's runs out in the order of arrival."""

    def __init__(self, limit: int = MEMORY_ENTRIES) -> None:
        self.runs: dict[int, list] = defaultdict(list)
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for k, (pos, lcp) in enumerate(runs):
                if isinstance(pos, np.ndarray):
                    runs[k] = (self.file.tell(), len(pos))
                    self.file.write(pos.astype(np.int64).tobytes() + lcp.astype(np.uint16).tobytes())
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        runs = self.runs.pop(symbol, None)
        if not runs:
            return None
        out = []
        for pos, lcp in runs:
            if isinstance(pos, np.ndarray):
                self.held -= len(pos)
                out.append((pos, lcp))
            else:
                self.file.seek(pos)
                data = self.file.read(lcp * 10)
                out.append((np.frombuffer(data, np.int64, lcp), np.frombuffer(data, np.uint16, lcp, lcp * 8)))
        return np.concatenate([p for p, _ in out]), np.concatenate([x for _, x in out])


def _range_minima(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of v[lo..hi], both ends included, for many ranges."""
    level = (np.frexp((hi - lo + 1).astype(np.float64))[1] - 1).astype(np.int64)
    out = np.empty(len(lo), dtype=v.dtype)
    row = v
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(row[lo[here]], row[hi[here] - (1 << k) + 1])
    return out


class _Sorter:
    def __init__(self, text: np.ndarray, cap: int) -> None:
        """text: symbols; the last is 0 and the only 0. Prefixes are compared up to cap symbols."""
        n = len(text)
        self.text, self.n, self.cap, self.sigma = text, n, cap, int(text.max()) + 1
        step = np.sign(np.diff(text.astype(np.int32)))
        change = np.flatnonzero(step)
        run_end = np.repeat(change, np.diff(np.concatenate([[-1], change])))  # for each position but the last: where its run of one symbol ends
        self.rises = _room(n, bool)  # whether the suffix is less than its successor
        self.rises[:-1] = step[run_end] > 0
        self.rises[-1] = True
        self.same = _room(n, np.uint16)
        self.same[:-1] = np.minimum(run_end - np.arange(n - 1) + 1, cap)
        self.same[-1] = 1
        self.is_low = _room(n, bool)
        self.is_low[1:] = self.rises[1:] & ~self.rises[:-1]
        self.low = np.flatnonzero(self.is_low)

    def _hand_out(self, queue: Queue, pos: np.ndarray, lcp: np.ndarray, rising: bool, since: np.ndarray, fresh: np.ndarray) -> None:
        """Gives each suffix's left neighbour, if it is of the kind wanted, to the queue under its own first symbol.

        since: for each symbol the least common prefix since the last suffix that gave to it; fresh: nothing given yet.
        """
        left = pos - 1
        index = np.flatnonzero((pos > 0) & (self.rises[left] == rising))
        symbol = self.text[left[index]]
        order = np.argsort(symbol, kind="stable")
        index, symbol = index[order], symbol[order]
        head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(index) else np.zeros(0, np.int64)
        lo = np.zeros(len(index), dtype=np.int64)
        lo[1:] = index[:-1] + 1
        lo[head] = 0
        common = _range_minima(lcp, lo, index).astype(np.int64)
        at = symbol[head].astype(np.int64)
        common[head] = np.minimum(common[head], since[at])
        common = np.minimum(common + 1, self.cap).astype(np.uint16)
        common[head[fresh[at]]] = 0
        if len(lcp):
            np.minimum(since, int(lcp.min()), out=since)
        if len(index):
            tail = np.append(head[1:], len(index)) - 1
            rest = index[tail] + 1
            some = rest < len(lcp)
            since[at] = self.cap
            since[at[some]] = _range_minima(lcp, rest[some], np.full(some.sum(), len(lcp) - 1))
        fresh[at] = False
        given = left[index]
        for k, s in enumerate(at.tolist()):
            a, b = head[k], head[k + 1] if k + 1 < len(head) else len(index)
            queue.push(s, given[a:b], common[a:b])

    def induce(self, low: np.ndarray, lcp: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """From the low suffixes in order (lcp: with the one before) to all suffixes, emitted in descending order with what each has in
        common with the one emitted before."""
        queue, falling = Queue(), Queue()
        since, fresh = np.full(self.sigma, self.cap, dtype=np.int64), np.ones(self.sigma, dtype=bool)
        bound = np.searchsorted(self.text[low], np.arange(self.sigma + 1))
        for c in range(self.sigma):
            last = None
            while (run := queue.take(c)) is not None:
                falling.push(c, *run)
                last = run[0][-1]
                self._hand_out(queue, *run, False, since, fresh)
            a, b = bound[c], bound[c + 1]
            if b > a:
                here = lcp[a:b].copy()
                here[0] = 0 if last is None else min(self.same[last], self.same[low[a]])
                self._hand_out(queue, low[a:b], here, False, since, fresh)
        since, fresh = np.full(self.sigma, self.cap, dtype=np.int64), np.ones(self.sigma, dtype=bool)
        for c in range(self.sigma - 1, -1, -1):
            last = None
            while (run := queue.take(c)) is not None:
                last = run[0][-1]
                emit(*run)
                self._hand_out(queue, *run, True, since, fresh)
            run = falling.take(c)
            if run is not None:
                pos, up = run[0][::-1], run[1][::-1]
                down = np.empty_like(up)
                down[1:] = up[:-1]
                down[0] = 0 if last is None else min(self.same[last], self.same[pos[0]])
                emit(pos, down)
                self._hand_out(queue, pos, down, True, since, fresh)

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        down = powers(pow(_BASE, -1, 1 << 64), self.n)
        p = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(seeds(41, self.sigma)[self.text] * down, out=p[1:])
        return p, powers(_BASE, self.n + 1)

    def sorted_low(self) -> tuple[np.ndarray, np.ndarray]:
        """The low suffixes in order of their first cap symbols, and their common prefixes up to cap."""
        low = self.low
        order = low[np.argsort(self.text[low], kind="stable")]
        got: list[np.ndarray] = []
        self.induce(order, np.zeros(len(low), dtype=np.uint16), lambda pos, _: got.append(pos[self.is_low[pos]]))
        by_stretch = np.concatenate([[self.n - 1], np.concatenate(got)[::-1]] if got else [[self.n - 1]]).astype(np.int64)
        by_stretch = by_stretch[np.concatenate([[True], by_stretch[1:] != self.n - 1])]
        number = _room(self.n, np.int64)
        number[low] = np.arange(len(low))
        p, up = self._hashes()
        end = np.minimum(np.append(low[1:], self.n - 1) + 1, self.n)
        print_ = mix((p[end] - p[low]) * up[low] + (end - low).astype(np.uint64))
        k = number[by_stretch]
        name = np.zeros(len(low), dtype=np.int64)
        name[k] = np.concatenate([[0], np.cumsum(print_[k][1:] != print_[k][:-1])])
        # Doubling: names of 1, 2, 4 ... stretches, until they differ or cover cap symbols (a stretch advances by two at least).
        width = 1
        while width * 2 < self.cap + 2 and name.max(initial=0) + 1 < len(name):
            nxt = np.zeros(len(name), dtype=np.int64)
            nxt[:-width] = name[width:] + 1
            _, name = np.unique(name * (len(name) + 1) + nxt, return_inverse=True)
            width *= 2
        order = low[np.argsort(name, kind="stable")]
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), dtype=np.int64)
        open_ = np.arange(len(a))
        for step in (self.cap, *(1 << k for k in range(self.cap.bit_length() - 1, -1, -1))):  # the longest equal prefix, bit by bit
            more = common[open_] + step
            fits = np.maximum(a[open_], b[open_]) + more <= self.n
            at, m = open_[fits], more[fits]
            x, y = a[at], b[at]
            equal = (p[x + m] - p[x]) * up[x] == (p[y + m] - p[y]) * up[y]
            common[at[equal]] = m[equal]
            if step == self.cap:
                open_ = np.flatnonzero(common < self.cap)
        return order, np.concatenate([[0], np.minimum(common, self.cap)]).astype(np.uint16)


def suffix_order(text: np.ndarray, cap: int, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Emits the suffixes of text (symbols from 1), ordered by their first cap symbols, in descending order: positions, and the length (up
    to cap) that each shares with the one before."""
    s = _Sorter(np.append(text, 0).astype(np.uint16), cap)
    low, lcp = s.sorted_low()
    s.induce(low, lcp, emit)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes start anywhere else in the texts, too."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.uint16) + 2
    text[at[1:] - 1] = 1
    twice = _room(len(text) + 1, bool)
    last = np.zeros(1, dtype=np.int64)

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        hit = np.flatnonzero(lcp >= length)
        twice[pos[hit]] = True
        before = np.where(hit > 0, pos[hit - 1], last[0])
        twice[before] = True
        last[0] = pos[-1]

    suffix_order(text, length, emit)
    return [twice[a : a + max(0, n - length + 1)].copy() for a, n in zip(at[:-1], size, strict=True)]
