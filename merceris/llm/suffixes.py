"""Suffix order and common-prefix values of a shard by external induced sorting.

``neighbours`` sorts the starred suffixes (S-type after L-type) by names that are doubled until they tell apart what
can matter, then induces all L-type suffixes from them in rising order and all S-type ones in falling order. Priority
queues keyed by the first symbol hold tuples (position, common prefix with the item before); within a key they are
first-in first-out, which is the order of suffixes. A queue keeps a bounded number of bytes and spills to disk beyond.
Numpy handles all items that leave a queue together in one step.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Bytes that one queue of a shard keeps in memory; an ordinary shard has more.
QUEUE_BYTES = 1 << 20


class DiskQueue:
    """Keys with first-in first-out rows of (position, common prefix); over ``limit`` bytes, all rows go to disk."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.size = limit, 0
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.spilled: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.file = None

    def push(self, key: int, positions: np.ndarray, commons: np.ndarray) -> None:
        self.rows[key].append((positions, commons))
        self.size += 5 * len(positions)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for key, parts in self.rows.items():
            positions, commons = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.file.seek(0, 2)
            self.spilled[key].append((self.file.tell(), len(positions)))
            self.file.write(positions.astype(np.int32).tobytes() + commons.astype(np.uint8).tobytes())
        self.rows.clear()
        self.size = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows of a key, oldest first."""
        parts = []
        for at, n in self.spilled.pop(key, ()):
            self.file.seek(at)
            raw = self.file.read(5 * n)
            parts.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint8, n, 4 * n)))
        own = self.rows.pop(key, [])
        self.size -= 5 * sum(len(p) for p, _ in own)
        parts += own
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        positions, commons = (np.concatenate(x) for x in zip(*parts, strict=True))
        return positions, commons

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Inducer:
    """One direction of induction: scans suffixes in order and pushes those one symbol longer."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: DiskQueue, symbols: int, cap: int):
        self.text, self.wanted, self.queue, self.cap = text, wanted, queue, cap
        # the least common prefix scanned since a key was last pushed; 0 before its first
        self.least = np.zeros(symbols, np.uint8)

    def scan(self, positions: np.ndarray, commons: np.ndarray) -> None:
        if not len(positions):
            return
        before = positions - 1
        chosen = np.flatnonzero((before >= 0) & self.wanted[before])
        keys = self.text[before[chosen]]
        order = np.argsort(keys, kind="stable")
        at, keys = chosen[order], keys[order]
        falling = np.minimum.accumulate(commons)
        if len(at):
            first = np.ones(len(at), bool)
            first[1:] = keys[1:] != keys[:-1]
            found = np.empty(len(at), np.uint8)
            found[first] = np.minimum(self.least[keys[first]], falling[at[first]])
            rest = np.flatnonzero(~first)
            found[rest] = _range_min(commons, at[rest - 1] + 1, at[rest])
            found = np.minimum(found.astype(np.int64) + 1, self.cap).astype(np.uint8)
            starts = np.flatnonzero(first)
            seen = keys[starts]
            if not self.begun[seen].all():
                found[starts[~self.begun[seen]]] = 0
                self.begun[seen] = True
            self.least = np.minimum(self.least, falling[-1])
            stops = np.append(starts[1:], len(at))
            rising = np.append(np.minimum.accumulate(commons[::-1])[::-1], np.uint8(self.cap))
            self.least[seen] = rising[at[stops - 1] + 1]
            longer = before[at]
            for key, a, b in zip(seen.tolist(), starts.tolist(), stops.tolist(), strict=True):
                self.queue.push(key, longer[a:b], found[a:b])
        else:
            self.least = np.minimum(self.least, falling[-1])

    @property
    def begun(self) -> np.ndarray:
        if not hasattr(self, "_begun"):
            self._begun = np.zeros(len(self.least), bool)
        return self._begun


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair, by tables of powers of two."""
    out = np.empty(len(first), values.dtype)
    power = np.floor(np.log2(last - first + 1)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    table, k = values, 0
    for wanted in range(int(power.max(initial=0)) + 1):
        while k < wanted:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
            k += 1
        own = np.flatnonzero(power == wanted)
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << wanted) + 1])
    return out


def _starred(text: np.ndarray, small: np.ndarray, stars: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starred positions in suffix order as far as ``cap`` symbols tell, and common prefixes with the one before."""
    n, m = len(text), len(stars)
    typed = (text.astype(np.uint64) << np.uint64(1) | small).astype(np.uint64)
    ends = np.append(stars[1:], n - 1)
    # names of starred substrings, six typed symbols a word, from the last word to the first
    words = -(-(ends - stars + 1) // 6)
    names = np.zeros(m, np.int64)
    padded = np.append(typed, np.zeros(6, np.uint64))
    del typed
    for k in range(int(words.max(initial=1)) - 1, -1, -1):
        own = np.flatnonzero(words > k)
        at = stars[own] + 6 * k
        word = np.zeros(len(own), np.uint64)
        for i in range(6):
            word = word << np.uint64(10) | np.where(at + i <= ends[own], padded[np.minimum(at + i, n)], np.uint64(0))
        order = np.lexsort((names[own], word))
        changed = np.ones(len(own), np.int64)
        changed[1:] = (word[order[1:]] != word[order[:-1]]) | (names[own][order[1:]] != names[own][order[:-1]])
        ranks = np.empty(len(own), np.int64)
        ranks[order] = np.cumsum(changed)
        names[own] = ranks
    del padded, words
    # a starred substring is two symbols or more, so cap names are enough; only names that are shared are doubled
    ranks = np.empty(m, np.int64)
    order = np.argsort(names, kind="stable")
    ranks[order] = _starts(names[order]) + 1
    live, step = np.flatnonzero(np.bincount(ranks, minlength=m + 2)[ranks] > 1), 1
    while step < cap and len(live):
        follow = np.where(live + step < m, ranks[np.minimum(live + step, m - 1)], 0)
        live = live[np.lexsort((follow, ranks[live]))]
        follow = np.where(live + step < m, ranks[np.minimum(live + step, m - 1)], 0)
        old = ranks[live]
        fresh = _starts(old * (m + 2) + follow)
        ranks[live] = old + fresh - _starts(old)
        size = np.bincount(fresh, minlength=len(live))[fresh]
        live = live[size > 1]
        step *= 2
    order = stars[np.argsort(ranks, kind="stable")]
    # common prefixes of neighbours, seven symbols a word
    far = np.append(text.astype(np.uint64), np.zeros(7, np.uint64))
    words = far[:n]
    for i in range(1, 7):
        words = words << np.uint64(9) | far[i : n + i]
    del far
    commons = np.zeros(m, np.int64)
    live = np.arange(1, m)
    for k in range(0, cap, 7):
        a, b = order[live - 1] + k, order[live] + k
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        same = np.zeros(len(live), np.int64)
        for i in range(7):
            same += differ >> np.uint64(9 * i) == 0
        commons[live] += same
        live = live[same == 7]
        if not len(live):
            break
    return order, np.minimum(commons, cap).astype(np.uint8)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index at which each one's run of equal keys begins."""
    changed = np.ones(len(keys), bool)
    changed[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(changed, np.arange(len(keys)), 0))


def neighbours(text: np.ndarray, cap: int = 200, limit: int = QUEUE_BYTES) -> np.ndarray:
    """For each position, the longest prefix (up to ``cap`` < 256) that its suffix shares with any other suffix.

    text: symbols of 0 to 511, of which the last is smaller than any other.
    """
    n = len(text)
    text = text.astype(np.uint16)
    out = np.zeros(n, np.uint8)
    if n < 2:
        return out
    # small: S-type. Equal neighbours are of the type at the end of their run.
    turn = np.flatnonzero(text[1:] != text[:-1]).astype(np.int32)
    places = np.arange(n, dtype=np.int32)
    run_end = turn[np.minimum(np.searchsorted(turn, places), len(turn) - 1)]
    small = np.ones(n, bool)
    small[:-1] = text[run_end[:-1]] < text[run_end[:-1] + 1]
    runs = np.minimum(np.where(places <= turn[-1], run_end - places + 1, n - places), cap).astype(np.uint8)
    del turn, places, run_end
    stars = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    order, commons = _starred(text, small, stars, cap)
    del stars
    symbols = int(text.max()) + 1
    bounds = np.searchsorted(text[order], np.arange(symbols + 1))
    zero = np.zeros(1, np.uint8)

    def note(positions: np.ndarray, commons: np.ndarray) -> None:
        out[positions] = np.maximum(out[positions], commons)
        if len(positions) > 1:
            out[positions[:-1]] = np.maximum(out[positions[:-1]], commons[1:])

    queue, large = DiskQueue(limit), DiskQueue(limit)
    induce = _Inducer(text, ~small, queue, symbols, cap)
    present = np.unique(text).tolist()
    for c in present:
        last = None
        while True:
            positions, own = queue.pop(c)
            if not len(positions):
                break
            own = own.copy()
            induce.scan(positions, own)
            large.push(c, positions, own)
            last = positions[-1]
        seeds, own = order[bounds[c] : bounds[c + 1]], commons[bounds[c] : bounds[c + 1]].copy()
        if len(seeds):
            own[:1] = zero if last is None else min(runs[last], runs[seeds[0]])
            induce.scan(seeds, own)
    queue.close()
    queue = DiskQueue(limit)
    induce = _Inducer(text, small, queue, symbols, cap)
    for c in reversed(present):
        last = None
        while True:
            positions, own = queue.pop(c)
            if not len(positions):
                break
            if last is not None:
                note(np.array([last, positions[0]]), np.array([0, own[0]], np.uint8))
            note(positions, np.concatenate([zero, own[1:]]))
            induce.scan(positions, own)
            last = positions[-1]
        positions, own = large.pop(c)
        if len(positions):
            note(positions, np.concatenate([zero, own[1:]]))
            # from the end: an item's common prefix is now that with the item after it
            positions = positions[::-1]
            own = np.append(np.uint8(0), own[:0:-1])
            if last is not None:
                own[0] = min(runs[last], runs[positions[0]])
                note(np.array([last, positions[0]]), np.array([0, own[0]], np.uint8))
            induce.scan(positions, own)
    queue.close()
    large.close()
    return out
