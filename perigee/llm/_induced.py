"""Suffix sorting of one shard by external induced sorting, with common-prefix values.

Left-most S suffixes are named and put in order (recursively: the string of their names is
refined by doubling until every name is its own or the windows are passed).  Then two scans
induce the rest: the smallest suffix in a priority queue, keyed by its first symbol and, within
it, by the order of arrival, is taken out and its left neighbour put in.  A tuple in a queue is
(position, length of the prefix it shares with the tuple before it); the shared length of two
induced suffixes is one more than the least of those between their sources.  Tuples are taken
out and put in a bucket at a time, and buckets beyond a budget of memory go to temporary files,
so a shard needs memory for its text and not for its suffixes.
"""

from __future__ import annotations

import tempfile

import numpy as np

_SENTINEL, _BREAK, _FIRST = 0, 1, 2  # symbols: end of shard, end of a piece, byte 0
_SYMBOLS = 258
_PAD = 511
#: Bytes of tuples held in memory by the queues of one scan; a shard of 2 MiB has three times as many.
QUEUE_BYTES = 4 << 20


class _Queues:
    """A priority queue of (symbol; position, shared prefix), first in, first out for each symbol."""

    def __init__(self, budget: int | None = None):
        self.mem: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(_SYMBOLS)]
        self.files: list = [None] * _SYMBOLS
        self.sizes: list[list[int]] = [[] for _ in range(_SYMBOLS)]
        self.held, self.budget = 0, budget or QUEUE_BYTES

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.mem[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        for s in range(_SYMBOLS):
            if self.mem[s]:
                if self.files[s] is None:
                    self.files[s] = tempfile.TemporaryFile()
                pos, lcp = (np.concatenate(x) for x in zip(*self.mem[s], strict=True))
                self.files[s].seek(0, 2)
                pos.astype(np.int32).tofile(self.files[s])
                lcp.astype(np.int16).tofile(self.files[s])
                self.sizes[s].append(len(pos))
                self.mem[s] = []
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All that the symbol's queue holds, in order."""
        parts = []
        if self.files[symbol] is not None:
            f = self.files[symbol]
            f.seek(0)
            for n in self.sizes[symbol]:
                parts.append((np.fromfile(f, np.int32, n), np.fromfile(f, np.int16, n)))
            f.close()
            self.files[symbol], self.sizes[symbol] = None, []
        parts += self.mem[symbol]
        self.held -= sum(a.nbytes + b.nbytes for a, b in self.mem[symbol])
        self.mem[symbol] = []
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x[a..b], both included, for many ranges."""
    size = b - a + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    top = int(level.max(initial=0))
    tables, base, offset = [x], [0], len(x)
    for k in range(top):
        x = np.minimum(x[: -(1 << k)], x[1 << k :]) if len(x) > 1 << k else x[:0]
        tables.append(x)
        base.append(offset)
        offset += len(x)
    flat, at = np.concatenate(tables), np.array(base)[level]
    return np.minimum(flat[at + a], flat[at + b - (1 << level) + 1])


class _Induction:
    """One scan: takes batches of a bucket in order and feeds the queues of the left neighbours."""

    def __init__(self, text: np.ndarray, cap: int):
        self.text, self.cap, self.queues = text, cap, _Queues()
        self.since = np.full(_SYMBOLS, -1, np.int16)  # least shared prefix since a symbol's last tuple; -1 before the first

    def take(self, pos: np.ndarray, lcp: np.ndarray, wanted: np.ndarray) -> None:
        if not len(pos):
            return
        idx = np.flatnonzero(wanted)
        low = np.int16(lcp.min())
        if not len(idx):
            np.minimum(self.since, low, out=self.since)
            return
        symbol = self.text[pos[idx] - 1]
        order = np.argsort(symbol, kind="stable")
        idx, symbol = idx[order], symbol[order]
        new = np.ones(len(idx), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(idx))
        value = np.empty(len(idx), np.int16)
        value[begin] = np.minimum(self.since[symbol[begin]], np.minimum.accumulate(lcp)[idx[begin]])
        rest = np.flatnonzero(~new)
        if len(rest):
            value[rest] = _range_min(lcp, idx[rest - 1] + 1, idx[rest])
        value = np.minimum(value + 1, self.cap).astype(np.int16)
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(self.cap))
        np.minimum(self.since, low, out=self.since)
        self.since[symbol[begin]] = after[idx[end - 1] + 1]
        child = (pos[idx] - 1).astype(np.int32)
        for s, a, b in zip(symbol[begin].tolist(), begin.tolist(), end.tolist(), strict=True):
            self.queues.push(s, child[a:b], value[a:b])


def _refine(rank: np.ndarray, sub: np.ndarray, key: np.ndarray) -> None:
    """Ranks are places of first equals; those of ``sub`` (whole groups) are parted by ``key``."""
    own = rank[sub]
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(own[order], kind="stable")]
    own, key = own[order], key[order]
    n = np.arange(len(sub))
    group = np.ones(len(sub), bool)
    group[1:] = own[1:] != own[:-1]
    part = group.copy()
    part[1:] |= key[1:] != key[:-1]
    at = np.maximum.accumulate(np.where(part, n, 0)) - np.maximum.accumulate(np.where(group, n, 0))
    rank[sub[order]] = own + at


def _open(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _names(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between neighbouring left-most S places, ends included.

    Where one is a prefix of another, the longer is less: it goes on with an L place.
    """
    size = np.append(np.diff(lms) + 1, 1)
    rank, off = np.zeros(len(lms), np.int64), 0
    sub = np.arange(len(lms))
    step = np.arange(7)
    while len(sub) and (size[sub] > off).any():
        symbols = text[np.minimum(lms[sub, None] + (off + step), len(text) - 1)].astype(np.uint64)
        symbols[(off + step) >= size[sub, None]] = _PAD
        key = np.zeros(len(sub), np.uint64)
        for j in range(7):
            key = (key << np.uint64(9)) | symbols[:, j]
        _refine(rank, sub, key)
        off += 7
        sub = _open(rank)
    return rank


def _sorted_lms(text: np.ndarray, lms: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Left-most S places in suffix order, and the prefix each shares with the one before it."""
    m = len(lms)
    rank = _names(text, lms)
    levels, step = [rank.astype(np.int32)], 1
    sub = _open(rank)
    while len(sub) and 2 * step < cap + 2:  # a name spans two bytes at least beyond the next
        ahead = np.zeros(len(sub), np.int64)
        inside = sub + step < m
        ahead[inside] = levels[-1][sub[inside] + step] + 1
        _refine(rank, sub, ahead)
        levels.append(rank.astype(np.int32))
        step *= 2
        sub = _open(rank)
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    skip = np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + skip, b + skip
        ok = np.flatnonzero((x < m) & (y < m))
        skip[ok[levels[k][x[ok]] == levels[k][y[ok]]]] += 1 << k
    x, y = np.minimum(a + skip, m - 1), np.minimum(b + skip, m - 1)
    lcp = lms[x] - lms[a]
    live = np.flatnonzero(lcp < cap)
    p, q, n = lms[a], lms[b], len(text)
    while len(live):
        i, j = p[live] + lcp[live], q[live] + lcp[live]
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        live = live[text[i] == text[j]]
        lcp[live] += 1
        live = live[lcp[live] < cap]
    return lms[order].astype(np.int32), np.concatenate([[0], np.minimum(lcp, cap)]).astype(np.int16)


def repeated_starts(pieces: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each piece (bytes), whether the window that starts at each place also starts elsewhere.

    Windows lie within pieces; places with fewer bytes left are false.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.full(int(first[-1]) + 1, _BREAK, np.int16)
    for p, a in zip(pieces, first[:-1].tolist(), strict=True):
        text[a : a + len(p)] = p
        text[a : a + len(p)] += _FIRST
    text[-1] = _SENTINEL
    n = len(text)

    # runs of equal symbols give the types: S if what follows the run is greater
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    length = np.diff(np.append(begin, n))
    kind = np.ones(len(begin), bool)
    kind[:-1] = text[begin[1:]] > text[begin[:-1]]
    is_s = np.repeat(kind, length)
    run = np.minimum(np.repeat(begin + length, length) - np.arange(n), window).astype(np.int16)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds, seed_lcp = _sorted_lms(text, lms, window)
    bounds = np.searchsorted(text[seeds], np.arange(_SYMBOLS + 1))

    found = np.zeros(n, bool)

    def mark(pos: np.ndarray, lcp: np.ndarray) -> None:
        hit = np.flatnonzero(lcp >= window)
        hit = hit[hit > 0]
        found[pos[hit]] = True
        found[pos[hit - 1]] = True

    def left(pos: np.ndarray) -> np.ndarray:
        return np.where(pos > 0, text[pos - 1], -1)

    # ascending: L suffixes
    scan = _Induction(text, window)
    done = _Queues()
    for c in range(_SYMBOLS):
        last = -1
        while len((got := scan.queues.pop(c))[0]):
            pos, lcp = got
            scan.take(pos, lcp, left(pos) >= c)
            done.push(c, pos, lcp)
            last = int(pos[-1])
        a, b = int(bounds[c]), int(bounds[c + 1])
        if b > a:
            pos, lcp = seeds[a:b], seed_lcp[a:b].copy()
            lcp[0] = 0 if last < 0 else min(run[last], run[pos[0]])
            scan.take(pos, lcp, left(pos) >= c)
    # descending: S suffixes
    scan = _Induction(text, window)
    for c in range(_SYMBOLS - 1, -1, -1):
        last, tail = -1, None
        while len((got := scan.queues.pop(c))[0]):
            pos, lcp = got
            scan.take(pos, lcp, (left(pos) <= c) & (pos > 0))
            mark(pos, lcp)
            if tail is not None and lcp[0] >= window:
                found[tail] = found[pos[0]] = True
            last = tail = int(pos[-1])
        pos, lcp = done.pop(c)
        if len(pos):
            mark(pos, lcp)
            down = np.empty(len(pos), np.int16)
            down[0] = 0 if last < 0 else min(run[last], run[pos[-1]])
            down[1:] = lcp[1:][::-1]
            if down[0] >= window:
                found[last] = found[pos[-1]] = True
            pos = pos[::-1]
            scan.take(pos, down, (left(pos) < c) & (pos > 0))
    for a, s in zip(first[:-1].tolist(), sizes.tolist(), strict=True):
        found[a + max(0, s - window + 1) : a + s] = False  # what would reach into the next piece
    return [found[a : a + s] for a, s in zip(first[:-1].tolist(), sizes.tolist(), strict=True)]
