"""Best-fit packing of token pieces, after a Martello-Toth dominance reduction.

Pieces are counted by length (at most ``capacity`` lengths, whatever the input), so the plan is made on the driver over
that histogram. The reduction fixes sets that dominate every alternative: a pair that fills a sequence, a piece that
nothing fits beside, and the largest fitting partner where no set of others could use the room better. The rest is
packed best-fit, longest first. The plan, a bounded table, is then looked up by each piece's length and number.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, spelt_out, stored

CAPACITY = 2048
#: Words whose ids a worker remembers, and as many that were in use before these.
REMEMBERED = 125_000

#: Texts that a task holds as Python strings at once.
AT_ONCE = 250
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"

Pattern = tuple[tuple[int, int], ...]  # (length, copies), the sequence's pieces in order


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Fix dominating sets for good: (sequences, pattern) and the counts that are left."""
    left = {w: n for w, n in counts.items() if n}
    fixed: list[tuple[int, Pattern]] = []

    def take(times: int, pattern: Pattern) -> None:
        fixed.append((times, pattern))
        for w, k in pattern:
            left[w] -= times * k
            if not left[w]:
                del left[w]

    for w in sorted(left, reverse=True):
        if w == capacity:
            take(left[w], ((w, 1),))
        elif w in left and capacity - w in left:  # a pair without waste
            other = capacity - w
            times = left[w] // 2 if other == w else min(left[w], left[other])
            if times:
                take(times, ((w, 2),) if other == w else ((w, 1), (other, 1)))
    changed = True
    while changed and left:
        changed = False
        sizes = sorted(left)
        for w in sorted(left, reverse=True):
            if w not in left:
                continue
            room = capacity - w
            smallest: list[int] = []  # the three shortest others
            for s in sizes:
                smallest += [s] * min(3, left.get(s, 0) - (s == w))
                if len(smallest) >= 3:
                    break
            if not smallest or smallest[0] > room:
                take(left[w] if smallest and smallest[0] != w else left.get(w, 0), ((w, 1),))
                changed = True
                continue
            at = bisect_left(sizes, room + 1) - 1
            while at >= 0 and left.get(sizes[at], 0) - (sizes[at] == w) < 1:
                at -= 1
            partner = sizes[at]
            pair = smallest[0] + smallest[1] if len(smallest) > 1 else capacity
            three = sum(smallest) if len(smallest) > 2 else capacity
            if pair > room or three > room and partner >= _best_pair(sizes, left, w, room):
                # this holds for as many copies as keep the partner and the shortest others as they are
                times = left[w] // 2 if partner == w else min(left[w], left[partner])
                if partner in smallest:
                    times = min(times, 1)
                take(max(1, times), ((w, 2),) if partner == w else ((w, 1), (partner, 1)))
                changed = True
            else:
                break  # shorter pieces have more room still
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], w: int, room: int) -> int:
    """The largest sum of two other pieces that fits into ``room``; 0 if none does."""
    best, a, b = 0, 0, len(sizes) - 1
    have = lambda s: left.get(s, 0) - (s == w)
    while a <= b:
        x, y = sizes[a], sizes[b]
        if have(x) < 1:
            a += 1
        elif have(y) < 1 or x + y > room or a == b and have(x) < 2:
            b -= 1
        else:
            best = max(best, x + y)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Longest first, each piece into the fullest sequence that takes it; equal sequences are handled together."""
    rooms: list[int] = []  # sorted distinct rooms of open sequences
    groups: dict[int, list[tuple[int, Pattern]]] = {}

    def put(room: int, times: int, pattern: Pattern) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((times, pattern))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                times, pattern = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, times, pattern = capacity, -(-n // (capacity // w)), ()
            k = room // w
            whole = min(times, n // k)
            put(room - k * w, whole, (*pattern, (w, k)))
            n -= whole * k
            if whole < times:
                rest = min(n, k - 1)
                put(room - rest * w, 1 if rest else 0, (*pattern, (w, rest)))
                put(room, times - whole - (1 if rest else 0), pattern)
                n -= rest
    return [g for room in rooms for g in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, copies in a sequence, first sequence, offset of the first copy), by length and number."""
    fixed, left = reduce_by_dominance(counts, capacity)
    rows, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for times, pattern in fixed + best_fit(left, capacity):
        offset = 0
        for w, k in pattern:
            rows.append((w, used[w], k, sequence, offset))
            used[w] += times * k
            offset += w * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


class Remembered(dict):
    """What ``make`` gave for each key. When full, what isn't asked for again before the next time is forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


class ChunkTokenizer:
    """Ids of a text from remembered ids of its words.

    For the word vocabulary, whose normalizer and pre-tokenizer never look across white space. Texts of plain Latin
    characters are lower-cased, split by the vocabulary's own pattern and given to its model word by word. Other texts
    are taken apart at white space; plain chunks are split in the same way, any other goes through the whole tokenizer.
    """

    #: str.split() also splits at these, which the vocabulary's pattern does not count as white space.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # characters that are composed already and whose lower case needs no context
        plain = "\x21-\x7e\xa1-\u012f\u0131-\u024f"
        self.plain_text = re.compile(f"[\\s{plain}]*").fullmatch
        self.plain = re.compile(f"[{plain}]+").fullmatch
        own = "".join(sorted({x for c in map(chr, range(0x250)) if self.plain(c) for x in (c, c.lower())}))
        with open(path, encoding="utf-8") as file:
            splits = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.split = re.compile(spelt_out(splits[0]["pattern"]["Regex"], own)).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.words, self.chunks = Remembered(self._word), Remembered(self._chunk)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.plain(chunk) and "<|" not in chunk:
            return b"".join(map(self.words.__getitem__, self.split(chunk.lower())))
        return self._whole(chunk)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.ODD):
            return self._whole(text)
        if self.plain_text(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, self.split(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.split()))


_tokenizers: dict[str, ChunkTokenizer] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every whole text once and cut only documents over ``capacity``.

    Rows (doc_id, piece, start, length, ids_crc32, part, number): number counts a task's pieces of one length from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = ChunkTokenizer(vocabulary)
        encode, part, seen = _tokenizers[vocabulary].encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(first, AT_ONCE).columns), strict=True):
                    ids = encode(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rows.append((doc, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and ids are pieces of their own; other columns are ignored;
    an empty table gives no rows. Pieces are numbered within their length by task, then by sums over tasks, so a length
    that most pieces share is spread over all tasks.
    """
    pieces = stored(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(counts, ["part", "length"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = int(table[:, 1].max()) + 1 if len(table) else 1
        keys = table[:, 0].astype(np.float64) * step + table[:, 1] if step * capacity < 2**52 else None
        for batch in batches:
            length, number = batch["length"].to_numpy(), (batch["before"] + batch["number"]).to_numpy()
            if keys is not None:
                at = np.searchsorted(keys, length.astype(np.float64) * step + np.minimum(number, step - 1), side="right") - 1
            else:
                at = np.array([np.searchsorted(table[:, 0], w) + np.searchsorted(table[table[:, 0] == w, 1], r, side="right") - 1 for w, r in zip(length, number, strict=True)])
            _, first, copies, sequence, offset = table[at].T
            inside = number - first
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"] = sequence + inside // copies
            out["offset"] = offset + inside % copies * length
            yield out

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
