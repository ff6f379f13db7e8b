"""Exact token counts of a byte-level BPE by finite-state transducers.

Two transducers are compiled from the vocabulary file. The first reads character classes and marks where pieces begin;
texts are cut into chunks, every chunk's map from entry state to exit state is built in step for all chunks, the maps
are composed by a parallel prefix scan, and each chunk is then read once more from its known entry state. The second
reads the bytes of a piece; each of its transitions carries how many tokens it adds to the count (less than 0 when a byte
joins tokens). The last token of a prefix is the longest token at its end that stands beside the last token of what
precedes it, so a transition needs one look-back, and which token pairs stand is compiled when a pair is first met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ids_and_texts, slices

#: Characters of one chunk of the scan; pieces and token pairs that a worker remembers before it starts anew.
CHUNK = 128
REMEMBERED = 1_000_000
#: Pieces of more bytes are read one by one.
LONG = 32
NEVER = 1 << 60

#: Multiplier of the hash by which substrings are looked up among the tokens.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def rolled(token: bytes) -> int:
    out = 0
    for c in token:
        out = (out * int(ROLL) + c + 1) % 2**64
    return out


# classes: a white space is "last" if a character other than white space follows it
LETTER, NUMBER, OTHER, SHORT, PAIR, SPACE, SPACE_LAST, WHITE, WHITE_LAST, BREAK = range(10)
# states: what was read last
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, IN_WHITE, ONE_MORE, TWO_MORE = range(9)

#: The code points of Unicode's White_Space property, as ranges.
WHITE_SPACE = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: What can follow an apostrophe in a contraction.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and begins[class, state]: whether a piece begins at the character."""
    after, begins = np.zeros((10, 9), np.uint8), np.zeros((10, 9), bool)
    fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: ONE_MORE, PAIR: TWO_MORE, SPACE: IN_WHITE, SPACE_LAST: AFTER_SPACE, WHITE: IN_WHITE, WHITE_LAST: AFTER_WHITE, BREAK: START}
    for kind, state in fresh.items():
        after[kind], begins[kind] = state, True
    for kind, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (PAIR, IN_OTHERS)):
        after[kind, AFTER_SPACE], begins[kind, AFTER_SPACE] = state, False  # the space belongs to what follows
        if state == IN_OTHERS or kind == LETTER or kind == NUMBER:
            after[kind, state], begins[kind, state] = state, False
    for kind in (SPACE, WHITE):
        begins[kind, IN_WHITE] = False
    for kind in range(9):
        after[kind, TWO_MORE], begins[kind, TWO_MORE] = ONE_MORE, False
        after[kind, ONE_MORE], begins[kind, ONE_MORE] = START, False
    return after, begins


NEXT, BEGINS = _transitions()


def scan(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, for a run of classes that starts in START."""
    n = len(kinds)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, BREAK, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    flat, states = NEXT.ravel(), NEXT.shape[1]
    maps = np.tile(np.arange(states, dtype=np.uint8), (lanes, 1))
    for row in steps:
        maps = flat[row[:, None].astype(np.int16) * states + maps]
    gap = 1
    while gap < lanes:  # after this, maps[k] goes from before chunk 0 to after chunk k
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), axis=1)
        gap *= 2
    state = np.empty(lanes, np.uint8)
    state[0], state[1:] = START, maps[:-1, START]
    out = np.empty((CHUNK, lanes), bool)
    mark = BEGINS.ravel()
    for k, row in enumerate(steps):
        at = row.astype(np.int16) * states + state
        out[k], state = mark[at], flat[at]
    return out.T.ravel()[:n]


def class_table() -> np.ndarray:
    """The class of every code point (plain: look-ahead is added later), and BREAK after the last."""
    import regex

    table = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = kind
    for first, last in WHITE_SPACE:
        table[first : last + 1] = WHITE
    table[32], table[0x110000] = SPACE, BREAK
    return table


class Counter:
    """Token counts for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = lambda token: bytes(map(byte.__getitem__, token))
        vocabulary = spec["model"]["vocab"]
        self.ids = {raw(token): k for token, k in vocabulary.items() if all(c in byte for c in token)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.longest = max(map(len, self.ids))
        # merges are numbered in their order; a token's parts are those of the first merge that makes it
        self.merge: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merge[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.parts.setdefault(vocabulary[left + right], (rank, vocabulary[left], vocabulary[right]))
        self.sides: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.table = class_table()
        random = np.random.default_rng(7)
        self.code = random.integers(0, 2**64, 0x110001, np.uint64)
        self.base = int(random.integers(0, 2**62)) * 2 + 1
        self.powers = np.ones(0, np.uint64)
        # remembered pieces by hash: their counts, and where their characters stand, as a hash alone proves nothing
        self.hashes, self.totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.places, self.lengths, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.beside: dict[int, bool] = {}
        self.border, self.kept = np.array([1 << 62]), np.array([False])
        codes = sorted((rolled(token), k) for token, k in self.ids.items())
        self.rolled, self.rolled_ids = np.array([c for c, _ in codes], np.uint64), np.array([k for _, k in codes])
        # a hit is compared with the token's own bytes: those of short tokens, and the length of all
        tokens = {k: raw for raw, k in self.ids.items()}
        self.rolled_size = np.array([len(tokens[k]) for _, k in codes])
        self.rolled_bytes = np.frombuffer(b"".join(tokens[k][:LONG].ljust(LONG, b"\0") for _, k in codes), np.uint8).reshape(-1, LONG)
        if len(np.unique(self.rolled)) < len(self.rolled):
            raise ValueError("two tokens of the vocabulary have one hash")

    def side(self, token: int, right: int) -> list[tuple[int, int]]:
        """The outermost token on one side while ``token`` is being merged: (token, rank of the merge that ends it)."""
        found = self.sides[right].get(token)
        if found is None:
            found, end, at = [], NEVER, token
            while True:
                found.append((at, end))
                if at not in self.parts:
                    break
                end, *both = self.parts[at]
                at = both[right]
            found.reverse()
            self.sides[right][token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when their bytes are encoded together.

        Merges go by rank, and of one rank from the left. So walk through the tokens that meet at the border while both
        sides are merged; the border goes if joining the two that meet comes before the next merge on either side.
        """
        key = left << 20 | right
        found = self.beside.get(key)
        if found is None:
            a, b, i, j = self.side(left, 1), self.side(right, 0), 0, 0
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                join = self.merge.get(x << 20 | y, NEVER)
                if join < x_ends and join <= y_ends and join != NEVER:
                    found = False
                    break
                if x_ends == y_ends == NEVER:
                    found = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.beside) > REMEMBERED:
                self.beside.clear()
            self.beside[key] = found
        return found

    def stand_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = np.searchsorted(self.border, keys)
        known = self.border[np.minimum(at, len(self.border) - 1)] == keys
        if not known.all():
            new = np.unique(keys[~known])
            if len(self.border) + len(new) > REMEMBERED:
                self.border, self.kept = self.border[-1:], self.kept[-1:]
                new = np.unique(keys)
            told = np.array([self.stands(k >> 20, k & 0xFFFFF) for k in new.tolist()])
            where = np.searchsorted(self.border, new)
            self.border, self.kept = np.insert(self.border, where, new), np.insert(self.kept, where, told)
            at = np.searchsorted(self.border, keys)
        return self.kept[at]

    def pieces(self, raws: list[bytes], width: int) -> np.ndarray:
        """Tokens of pieces of at most ``width`` bytes: the transducer reads all of them in step.

        Its state after i bytes is the row of last tokens so far; a transition takes the longest token at the end that
        stands beside the last token before it, and adds that look-back's count plus one, less the present count.
        """
        m = len(raws)
        size = np.fromiter(map(len, raws), np.int64, m)
        data = np.zeros((m, width), np.uint64)
        plain = np.zeros((m, width), np.uint8)
        plain[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
        data[:] = plain
        data[np.arange(width) < size[:, None]] += np.uint64(1)
        token = np.full((width + 1, m, width), -1, np.int32)  # by length, piece and start
        rolled = np.zeros((m, width), np.uint64)
        for n in range(1, width + 1):
            rolled = rolled[:, : width - n + 1] * ROLL + data[:, n - 1 :]
            row, start = np.nonzero(np.arange(width - n + 1) + n <= size[:, None])
            if not len(row):
                break
            want = rolled[row, start]
            at = np.minimum(np.searchsorted(self.rolled, want), len(self.rolled) - 1)
            hit = np.flatnonzero((self.rolled[at] == want) & (self.rolled_size[at] == n))
            row, start, at = row[hit], start[hit], at[hit]
            same = (plain[row[:, None], start[:, None] + np.arange(n)] == self.rolled_bytes[at, :n]).all(1)
            token[n, row[same], start[same]] = self.rolled_ids[at[same]]
        last, total = np.full((m, width + 1), -1, np.int64), np.zeros((m, width + 1), np.int64)
        for i in range(1, width + 1):
            rows = np.flatnonzero(size >= i)
            for n in range(i, 0, -1):
                if not len(rows):
                    break
                own = token[n, rows, i - n].astype(np.int64)
                fits = own >= 0
                if n < i and fits.any():
                    fits[fits] = self.stand_many(last[rows[fits], i - n], own[fits])
                done = rows[fits]
                last[done, i], total[done, i] = own[fits], total[done, i - n] + 1
                rows = rows[~fits]
        return total[np.arange(m), size]

    def piece(self, raw: bytes) -> int:
        """The same for one long piece."""
        last, total = [-1], [0]
        for i in range(1, len(raw) + 1):
            for n in range(min(i, self.longest), 0, -1):
                token = self.ids.get(raw[i - n : i])
                if token is not None and (n == i or self.stands(last[i - n], token)):
                    break
            last.append(token)
            total.append(total[i - n] + 1)
        return total[-1]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for row, text in enumerate(texts):
            cut = [text]
            for s in self.special:
                if s in text:
                    cut = [x for part in cut for x in part.split(s)]
            out[row] += len(cut) - 1
            parts += cut
            owner += [row] * len(cut)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        codes = np.full(int(sizes.sum()), 0x110000, np.uint32)
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = False
        codes[inside] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.table[codes]
        # look-ahead of one character for white space, of two for contractions
        white = (kinds == SPACE) | (kinds == WHITE)
        lasts = white[:-1] & ~white[1:] & (kinds[1:] != BREAK)
        marks = np.flatnonzero(codes == 39)
        kinds[:-1][lasts] += 1
        for end in ENDINGS:
            at = marks[marks + len(end) < len(codes)]
            for k, c in enumerate(end, 1):
                at = at[codes[at + k] == ord(c)]
            kinds[at] = SHORT if len(end) == 1 else PAIR
        starts = np.flatnonzero(scan(kinds))
        whose = np.repeat(np.array(owner, np.int64), sizes)[starts]
        stops = np.append(starts[1:], len(codes))
        real = kinds[starts] != BREAK
        if len(self.powers) < len(codes) + 1:
            own = np.full(len(codes) * 2 + 1, self.base, np.uint64)
            own[0] = 1
            self.powers = np.cumprod(own)
            own[1:] = pow(self.base, -1, 2**64)
            self.back = np.cumprod(own)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.code[codes] * self.powers[: len(codes)], out=sums[1:])
        starts, stops, whose = starts[real], stops[real], whose[real]
        lengths = stops - starts
        hashes = (sums[stops] - sums[starts]) * self.back[starts]
        fresh, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # pieces of one hash that are not the same are counted one by one
        other = np.flatnonzero(~_equal(codes, starts, codes, starts[first[which]], lengths, lengths[first[which]]))
        at = np.searchsorted(self.hashes, fresh)
        known = np.zeros(len(fresh), bool)
        met = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == fresh) if len(self.hashes) else np.zeros(0, np.int64)
        known[met] = _equal(codes, starts[first[met]], self.letters, self.places[at[met]], lengths[first[met]], self.lengths[at[met]])
        totals = np.zeros(len(fresh), np.int64)
        totals[known] = self.totals[at[known]]
        new = np.flatnonzero(~known)
        lanes: dict[int, list[tuple[int, bytes]]] = {8: [], 16: [], 32: []}
        for k, a, b in zip(new.tolist(), starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True):
            raw = codes[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                totals[k] = self.piece(raw)
            else:
                lanes[8 if len(raw) <= 8 else 16 if len(raw) <= 16 else 32].append((k, raw))
        for width, own in lanes.items():
            for at_once in range(0, len(own), 1 << 17 >> width.bit_length()):
                part = own[at_once : at_once + (1 << 17 >> width.bit_length())]
                totals[[k for k, _ in part]] = self.pieces([raw for _, raw in part], width)
        each = totals[which]
        for k in other.tolist():
            each[k] = self.piece(codes[starts[k] : stops[k]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
        # a piece whose hash is taken by another is never remembered, nor is a long one
        taken = np.zeros(len(fresh), bool)
        taken[met] = True
        self._remember(codes, *(x[new[~taken[new] & (lengths[first[new]] <= LONG)]] for x in (fresh, totals, starts[first], lengths[first])))
        out += np.bincount(whose, weights=each, minlength=len(texts)).astype(np.int64)
        return out

    def _remember(self, codes: np.ndarray, hashes: np.ndarray, totals: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        if not len(hashes):
            return
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.hashes, self.totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.places, self.lengths, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        before = np.cumsum(lengths) - lengths
        letters = codes[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.totals = np.insert(self.hashes, at, hashes), np.insert(self.totals, at, totals)
        self.places, self.lengths = np.insert(self.places, at, before + len(self.letters)), np.insert(self.lengths, at, lengths)
        self.letters = np.concatenate([self.letters, letters])


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n characters of ``a`` from each place ``at`` are the m characters of ``b`` from ``bt``."""
    out = n == m
    own = np.flatnonzero(out & ((at != bt) if a is b else True))
    if len(own):
        sizes = n[own]
        before = np.cumsum(sizes) - sizes
        steps = np.arange(int(sizes.sum()))
        differ = a[np.repeat(at[own] - before, sizes) + steps] != b[np.repeat(bt[own] - before, sizes) + steps]
        out[own] = ~np.logical_or.reduceat(differ, before)
    return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one narrow pass without a shuffle.

    Special strings of the vocabulary count as one token each, wherever they stand. Null and empty texts have no tokens;
    rows and repeated ids are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        count = _counters[vocabulary].count
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, end in slices(texts, 1_000_000):
                part = texts[first:end]
                tokens = count(part)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[first:end].astype("Int64"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in part], "n_tokens": tokens, "over_limit": tokens > limit})

    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
