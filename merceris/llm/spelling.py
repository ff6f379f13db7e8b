"""Spelling variants: words one edit apart, found by range searches in K-d trees over letter counts.

One inserted or deleted letter changes the vector of letter counts by one in one place, a replaced letter by one up and one
down, so the vectors of two near words are at most 2 apart in L1. The words of each length stand in a K-d tree, whose top is
learned from a bounded sample and whose cells hold all words. A word is a query to its own length's tree, where a
match may be one letter up and one down from it, and to that of the next length, where it may be one up. Boxes
that no such vector can lie in are pruned, first when words are dealt to cells, then in a tree of the cell's own words;
what is left is compared letter by letter. Each cell returns counts and best matches, never pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, ids_and_texts

#: Letters: a to z and the code points from 0xC0 to 0xFF; the place of each among the counts.
LETTERS = bytes([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
PLACE = np.zeros(256, np.int64)
PLACE[list(LETTERS)] = np.arange(len(LETTERS))
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Words from which the tops of the trees are learned, their length at most, and the words of a cell that are aimed at.
SAMPLE = 65_536
SAMPLE_LENGTH = 256
CELL = 4_096
#: Words of a leaf of a cell's own tree, and bytes compared at once.
LEAF = 24
AT_ONCE = 8_000_000
MEMBER, SAME, SHORTER = 0, 1, 2

#: A node is (place, value, left, right), left for counts up to the value; a leaf is what it holds.
Tree = tuple | int | np.ndarray


def variant(doc_id: object, start: int, run: str) -> str:
    """A run as this document has it: without one letter where 31 divides the CRC-32 of id and run. start: that of ``<id>:``."""
    h = zlib.crc32(run.encode(), start)
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words of at least ``least`` letters of all texts and how often they occur."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall  # runs are maximal: a match begins where its run does
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for own, n in Counter(find((text or "").encode().translate(LOWER).decode())).items():
                    word = variant(doc, start, own)
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        yield out()

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list[str], length: int) -> np.ndarray:
    """A row of letters for each of some words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(LETTERS)), np.int32)
    step = max(1, AT_ONCE // max(1, rows.shape[1]))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        at = PLACE[part] + np.arange(len(part))[:, None] * len(LETTERS)
        out[a : a + step] = np.bincount(at.ravel(), minlength=len(part) * len(LETTERS)).reshape(len(part), -1)
    return out


def grow(counts: np.ndarray, rows: np.ndarray, most: int) -> Tree:
    """A K-d tree whose leaves hold at most ``most`` of the rows, or rows of one vector only. Splits are the most even there are."""
    if len(rows) <= most:
        return rows
    own = counts[rows]
    middle = np.partition(own, len(rows) // 2, axis=0)[len(rows) // 2]
    upto, below = (own <= middle).sum(0), (own < middle).sum(0)
    even, lower = np.minimum(upto, len(rows) - upto), np.minimum(below, len(rows) - below)
    place = int(np.argmax(np.maximum(even, lower)))
    if not max(even[place], lower[place]):
        return rows
    value = int(middle[place]) - (lower[place] > even[place])
    left = own[:, place] <= value
    return place, value, grow(counts, rows[left], most), grow(counts, rows[~left], most)


def search(tree: Tree, counts: np.ndarray, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int | np.ndarray, np.ndarray]]:
    """(leaf, rows) of each leaf whose box has a vector that lies at most ``up`` letters above and ``down`` below a row's."""
    if not len(rows):
        return
    if not isinstance(tree, tuple):
        yield tree, rows
        return
    place, value, left, right = tree
    own = counts[rows, place]
    above, edge = own == value + 1, own == value  # one step away from the other side
    keep = (own <= value) | above & (down > 0)
    yield from search(left, counts, rows[keep], up[keep], (down - above)[keep])
    keep = (own > value) | edge & (up > 0)
    yield from search(right, counts, rows[keep], (up - edge)[keep], down[keep])


def learn_tops(sample: list[str], scale: float) -> dict[int, Tree]:
    """The top of each length's tree, with numbered cells; scale: words for each word of the sample."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    cells = iter(range(1 << 40))

    def numbered(tree: Tree) -> Tree:
        return (*tree[:2], numbered(tree[2]), numbered(tree[3])) if isinstance(tree, tuple) else next(cells)

    most = max(8, int(CELL / scale))
    return {length: numbered(grow(letter_counts(codes(words, length)), np.arange(len(words)), most)) for length, words in sorted(by_length.items())}


def deal(words: DataFrame, tops: dict[int, Tree]) -> DataFrame:
    """(cell, length, kind, word, n): each word in its own cell, and as a query in each further cell that may hold a near word."""
    schema = pa.schema([("cell", pa.int64()), ("length", pa.int32()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])

    def top(length: int) -> Tree:
        return tops.get(length, -length)  # lengths that the sample lacks have one cell each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch["word"]).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                word, n = batch["word"].take(pa.array(at)), batch["n"].take(pa.array(at))
                counts = letter_counts(codes(word.to_pylist(), length))
                rows = np.arange(len(at))
                none, one = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
                home, dealt = np.empty(len(at), np.int64), []
                for cell, own in search(top(length), counts, rows, none, none):
                    home[own] = cell
                    dealt.append((cell, length, MEMBER, own))
                dealt += [(cell, length, SAME, own[home[own] != cell]) for cell, own in search(top(length), counts, rows, one, one)]
                dealt += [(cell, length + 1, SHORTER, own) for cell, own in search(top(length + 1), counts, rows, one, none)]
                cell, size, kind = (np.repeat([d[k] for d in dealt], [len(d[3]) for d in dealt]) for k in range(3))
                taken = pa.array(np.concatenate([d[3] for d in dealt]))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(size, pa.int32()), pa.array(kind, pa.int8()), word.take(taken), n.take(taken)], schema=schema)

    return words.mapInArrow(run, "cell long, length int, kind byte, word string, n long")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of ``long`` is that of ``short`` with one more letter: what agrees from the front and from the back covers it."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= short.shape[1]


def near_pairs(queries: np.ndarray, members: np.ndarray, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, member) of all near pairs. shorter: queries have one letter less than members, else as many."""
    of_members, of_queries = letter_counts(members), letter_counts(queries)
    bit = np.uint64(1) << (np.arange(len(LETTERS)) % 64).astype(np.uint64)
    odd = lambda counts: np.bitwise_xor.reduce(np.where(counts & 1, bit, np.uint64(0)), axis=1)
    signs, asked = odd(of_members), odd(of_queries)  # a letter more or less flips one bit
    tree = grow(of_members, np.arange(len(members)), LEAF)
    one = np.ones(len(queries), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    test, step = (one_inserted if shorter else one_replaced), max(1, AT_ONCE // members.shape[1])
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def verify() -> None:
        if waiting:
            q, m = (np.concatenate([w[k] for w in waiting]) for k in range(2))
            waiting.clear()
            for a in range(0, len(q), step):
                fits = test(queries[q[a : a + step]], members[m[a : a + step]])
                found.append((q[a : a + step][fits], m[a : a + step][fits]))

    size = 0
    for leaf, rows in search(tree, of_queries, np.arange(len(queries)), one, one - shorter):
        for a in range(0, len(rows), max(1, AT_ONCE // len(leaf))):  # a leaf of one vector may be large
            part = rows[a : a + max(1, AT_ONCE // len(leaf))]
            q, m = np.nonzero(np.bitwise_count(asked[part][:, None] ^ signs[leaf]) <= 2 - shorter)
            waiting.append((part[q], leaf[m]))
            size += len(q)
            if size >= step:
                verify()
                size = 0
    verify()
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) if found else empty for k in range(2))


RESULT = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def in_cell(rows: pa.Table) -> pa.Table:
    """What a cell adds to the words that it meets: how many near words, and the best of them."""
    length, kind, n = rows["length"][0].as_py(), rows["kind"].to_numpy(), rows["n"].to_numpy()
    words = rows["word"].combine_chunks()
    members, shorter = np.flatnonzero(kind == MEMBER), np.flatnonzero(kind == SHORTER)
    same = np.flatnonzero(kind != SHORTER)
    letters = lambda at, size: codes(words.take(pa.array(at)).to_pylist(), size)
    told, other = [], []
    if len(members):
        own = letters(members, length)
        q, m = near_pairs(letters(same, length), own, False)
        told, other = [same[q]], [members[m]]
        if len(shorter):
            q, m = near_pairs(letters(shorter, length - 1), own, True)
            told, other = [*told, shorter[q], members[m]], [*other, members[m], shorter[q]]
    told, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (told, other))
    place = np.empty(len(n), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(n))
    order = np.lexsort((place[other], -n[other], told))
    told, other = told[order], other[order]
    first = np.flatnonzero(np.r_[True, told[1:] != told[:-1]]) if len(told) else np.zeros(0, np.int64)
    met = told[first]
    near, best = np.zeros(len(n), np.int64), np.full(len(n), -1)
    near[met], best[met] = np.diff(np.r_[first, len(told)]), other[first]
    out = np.flatnonzero((kind == MEMBER) | (near > 0))
    chosen = pa.array(best[out], pa.int64(), mask=best[out] < 0)
    return pa.table([words.take(pa.array(out)), pa.array(n[out]), pa.array(near[out]), pa.array(n).take(chosen), words.take(chosen)], schema=RESULT)


def roots(forms: DataFrame, most: int, scope: Scope) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last by pointer jumping. A form is ten times as frequent as its word, which bounds the chain."""
    reach = scope.stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log10(max(most, 1))))))):
        before, ahead = reach, reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reach = scope.stored(before.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
        scope.drop(before)
    return reach


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Each word's near words, its form and its root, from a table of distinct words (word, n) of letters a-z and U+00C0-U+00FF.

    Two words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its near word of
    the largest n, among equals the first in code-point order, if that n is at least ``ratio`` (10 or more) times the word's. Returns
    word, form, root, n, n_near and form_n; a word without a form is its own root.

    Rows with a null word or n are left out; equal words must not repeat. An empty table gives no rows; other columns are
    ignored. Words of one vector (anagrams) share a cell, however many they are, and are compared in blocks. Very
    long words are compared with those of the neighbouring lengths only.
    """
    if ratio < 10:
        raise ValueError("ratio must be at least 10")
    scope = Scope(words.sparkSession)
    own = scope.stored(words.select("word", "n").where("word is not null and n is not null"))
    total, most = own.agg(F.count("*"), F.max("n")).first()
    drawn = own.where(F.length("word") <= SAMPLE_LENGTH).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word")
    sample = [r["word"] for r in drawn.collect()]  # at most SAMPLE words
    dealt = deal(own, learn_tops(sample, max(1.0, total / max(1, len(sample)))))
    schema = "word string, n long, n_near long, best_n long, best string"
    met = dealt.groupBy("cell").applyInArrow(in_cell, schema)
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    seen = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    kept: Column = -F.col("best.less") >= ratio * F.col("n")
    found = scope.stored(seen.select("word", "n", "n_near", F.when(kept, F.col("best.best")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")))
    chains = roots(found.where("form is not null").select("word", "form"), most or 0, scope)
    scope.keep(found, chains)
    return found.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
