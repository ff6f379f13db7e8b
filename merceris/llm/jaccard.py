"""N-gram Jaccard join with token groups.

Documents with the same shingle set are one class. Two similar classes share a shingle among the first few of each in any
common order; here that of the shingles' hashes, with the most frequent shingles of the corpus last. Classes that meet
in a shingle are kept apart at once if a parity signature shows that too many of their shingles differ. What is left
falls into groups of similar classes. Inside a group, classes are dealt into blocks; a block's token union bounds the
overlap of each query of another block, and only where the bound suffices is the block opened and all pairs counted at
once by a product of 0/1 matrices. Blocks that are of one component already are never compared.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, finished, ids_and_texts, in_key_set, key_set, stored
from .components import components

#: Shingles in more first parts than this are put last, the most frequent ones of the corpus if they are very many.
FREQUENT = 8
MOST_FREQUENT = 1 << 21
#: Classes of a shingle up to which its pairs are tested one by one; the list of a shingle with more is dealt into blocks,
#: each of which gives fewer links than it has classes.
FEW = 8
#: Most classes and bytes of one block: of signatures, and of sets.
SIGNATURES = (512, 4 << 20)
SETS = (256, 4 << 20)
#: Tokens of one step of a matrix product.
WIDTH = 1 << 13
#: Bytes of a word up to which a table holds the letters' hashes.
NEAR = 64

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

#: Tells which pairs of two lists of (sizes, rows) may be linked.
Test = Callable[[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]], np.ndarray]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers for each letter at each of the first places of a word, and odd ones for the words of a shingle."""
    random = np.random.default_rng(int.from_bytes(key))
    return random.integers(0, 2**64, NEAR * 256, np.uint64), random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _word_hashes(letters: np.ndarray, sizes: np.ndarray, key: bytes) -> np.ndarray:
    """A hash of each word: the sum of its letters' random numbers, or a keyed digest of a longer word.

    Whatever two different words are, all but one in 2^64 keys tell them apart.
    """
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    values = _tables(key)[0][np.minimum(place, NEAR - 1) << 8 | letters]
    hashes = _mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _LENGTH)
    for k in np.flatnonzero(sizes > NEAR).tolist():
        word = letters[first[k] : first[k] + sizes[k]].tobytes()
        hashes[k] = int.from_bytes(hashlib.blake2b(word, key=key, digest_size=8).digest())
    return hashes


def shingle_sets(texts: list[str | None], words: int, key: bytes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one.

    Words and shingles are told apart by 64 bits under ``key``. Each call of an operator draws its own, so no text can be
    written beforehand whose words or shingles meet those of another. Hashes of different keys can't be compared.
    """
    place = _tables(key)[1]
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size < SLICE_BYTES):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            size += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        starts, stops = edge[::2], edge[1::2]
        hashes = _word_hashes(data[inside], stops - starts, key)
        ends = np.cumsum([len(p) + 1 for p in parts])
        last = np.searchsorted(starts, ends)
        first = np.concatenate([[0], last[:-1]])
        n = len(hashes) - words + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            if n > 0:
                grams += hashes[k : k + n] * place[k]
        grams = _mix(grams)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield _mix((hashes[a:b] * place[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n elements needs with any similar set."""
    return -(-n * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``: products of 0/1 matrices over shared tokens."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    shared = np.intersect1d(*flat)
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    places = [np.searchsorted(shared, x) for x in flat]
    known = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for p, x in zip(places, flat, strict=True)]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(shared), WIDTH):
        parts = []
        for x, row, place, fits in zip((a, b), rows, places, known, strict=True):
            own = fits & (place >= first) & (place < first + WIDTH)
            part = np.zeros((len(x), min(WIDTH, len(shared) - first)), np.float32)
            part[row[own], place[own] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _first_size(n: int, percent: int) -> int:
    """Shingles of a set of n, of which two similar sets share one at least in any common order."""
    return n - needed(n, percent) + 1


def _frequent_last(own: np.ndarray, frequent: np.ndarray, order: np.ndarray, size: int) -> np.ndarray | None:
    """The first ``size`` of rising hashes once frequent ones are put last, in their order; None if there are too few others."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = frequent[at] == own
        if often[:size].any():
            rare = own[~often]
            if len(rare) < size:
                return None
            return rare[:size]
    return own[:size] if len(own) >= size else None


def signature(own: np.ndarray) -> np.ndarray:
    """Parities of the number of hashes in each of at least len(own) cells (a power of two), 64 to a word.

    The parities in which two signatures of one width differ are never more than the hashes in which the sets differ.
    """
    cells = max(64, 1 << int(np.ceil(np.log2(max(len(own), 1)))))
    parity = np.bincount((own >> np.uint64(7) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(bool), bitorder="little").view("<u8")


def _fold(signs: np.ndarray, width: int) -> np.ndarray:
    """Rows of signatures at a smaller width: cells that become one add their parities."""
    while signs.shape[1] > width:
        half = signs.shape[1] // 2
        signs = signs[:, :half] ^ signs[:, half:]
    return signs


def close_pairs(n: np.ndarray, a: list[np.ndarray], m: np.ndarray, b: list[np.ndarray], percent: int) -> np.ndarray:
    """Index pairs whose sizes and signatures don't rule out 100 * intersection >= percent * union."""
    widths = [np.array([len(x) for x in rows]) for rows in (a, b)]
    found = [np.zeros((0, 2), np.int64)]
    for v in np.unique(widths[0]):
        for w in np.unique(widths[1]):
            rows, columns = np.flatnonzero(widths[0] == v), np.flatnonzero(widths[1] == w)
            sizes = n[rows][:, None], m[columns][None, :]
            fits = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            if not fits.any():
                continue
            x, y = (_fold(np.stack([part[k] for k in own]), min(v, w)) for part, own in ((a, rows), (b, columns)))
            differ = np.zeros(fits.shape, np.int64)
            for k in range(x.shape[1]):
                differ += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
            i, j = np.nonzero(fits & ((100 + percent) * differ <= (100 - percent) * (sizes[0] + sizes[1])))
            found.append(np.stack([rows[i], columns[j]], axis=1))
    return np.concatenate(found)


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Index pairs with 100 * intersection >= percent * union.

    A set of ``a`` is compared only if its overlap with the union of all of ``b`` suffices for the smallest of them.
    """
    if not a or not b:
        return np.zeros((0, 2), np.int64)
    rows = np.arange(len(a))
    if a is not b:
        union, least = np.unique(np.concatenate(b)), min(map(len, b))
        # a similar set of m elements overlaps by percent / (100 + percent) of both sizes together at least
        rows = np.array([k for k, q in enumerate(a) if (100 + percent) * int(np.isin(q, union, assume_unique=True).sum()) >= percent * (len(q) + least)], np.int64)
        if not len(rows):
            return np.zeros((0, 2), np.int64)
    own = [a[k] for k in rows]
    both = overlaps(own, b)
    total = np.array([len(x) for x in own])[:, None] + np.array([len(x) for x in b])[None, :]
    pairs = np.argwhere(100 * both >= percent * (total - both))
    return np.stack([rows[pairs[:, 0]], pairs[:, 1]], axis=1)


def _stars(pairs: np.ndarray, a: list, b: list) -> pd.DataFrame:
    """Links of the names that the pairs (indexes of names) join: the least of each component and each of its others."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        x, y = find(a[i]), find(b[j])
        if x != y:
            root[max(x, y)] = min(x, y)
    return pd.DataFrame([(find(x), x) for x in list(root) if find(x) != x], columns=["a", "b"])


def _edges(group: pd.DataFrame, test: Test) -> pd.DataFrame:
    """Links of the components (column ``component``) that one block joins, or two blocks (column ``side``) with each other."""
    sides = [group[group["side"] == k] for k in (1, 2)]
    own, other = ((g["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["data"]]) for g in sides)
    if not len(sides[1]):
        other, sides = own, [sides[0], sides[0]]
    return _stars(test(*own, *other), *(g["component"].tolist() for g in sides))


def _relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    """``labels`` (with a column component) once components are joined as ``step`` (node, component) tells."""
    step = step.select(F.col("node").alias("component"), F.col("component").alias("__joined"))
    return labels.join(step, "component", "left").withColumn("component", F.coalesce("__joined", "component")).drop("__joined")


def _linked(lists: DataFrame, links: DataFrame, test: Test, block: tuple[int, int]) -> DataFrame:
    """(node, component) by ``links`` and by such others that all classes that have a key in common and pass ``test`` are joined.

    lists: (key, home, cid, n, data). The list of a key is dealt into blocks. Inside a block all classes are compared, if
    it is the only one of its key or the key is the class's home. As long as that joins many, the least class of each
    component goes to blocks of its keys again; so a long list of similar classes becomes one component by a number of
    comparisons in proportion to its length. At last, in keys of several blocks that still hold several components,
    blocks of different components are compared. Links found later join components that are known, by their least
    classes, so no link is followed twice; and keys whose classes are one component are left out from then on.
    """
    most, most_bytes = block
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(size / most_bytes))
    names = ["key", "cid", "component", "n", "data"]
    run = lambda group: _edges(group, test)
    dealt = stored(lists.groupBy("key").agg(blocks(F.count("*"), F.sum(F.length("data"))).alias("blocks")))

    def within(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).select(*names, F.lit(1).alias("side"), "block")
        return stored(rows.groupBy("key", "block").applyInPandas(run, "a long, b long"))

    at_home = lists.join(dealt, "key").where("home or blocks = 1").withColumn("component", F.col("cid"))
    found = components(links.unionByName(within(at_home)))
    large = stored(dealt.where("blocks > 1").select("key"))
    if large.isEmpty():
        return found

    def joined(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``found`` and ``rows`` with links between least classes; a class without links so far is its own component."""
        step = components(more)
        known = found.unionByName(step.select("node", F.col("node").alias("component"))).distinct()
        return stored(_relabelled(known, step).select("node", "component")), _relabelled(rows, step)

    label = found.withColumnRenamed("node", "cid")
    light = lists.join(large, "key").select("key", "cid", F.length("data").alias("size"))
    rows = stored(light.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    before = None
    while True:
        several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        rows = stored(rows.join(several, "key"))
        leaders = stored(rows.groupBy("key", "component").agg(F.min("cid").alias("cid"), F.max("size").alias("size")))
        count = leaders.count()
        if not count:
            return found
        if before is not None and 2 * count > before:
            break
        before = count
        again = leaders.groupBy("key").agg(blocks(F.count("*"), F.count("*") * F.max("size")).alias("blocks"))
        more = within(lists.join(leaders.drop("size"), ["key", "cid"]).join(again, "key"))
        if more.isEmpty():
            break
        found, rows = joined(more)
    total = rows.groupBy("key").agg(blocks(F.count("*"), F.sum("size")).alias("parts"))
    each = rows.groupBy("key", "component").agg(blocks(F.count("*"), F.sum("size")).alias("own"))
    part = F.struct(F.pmod(F.xxhash64("component"), "parts").alias("part"), F.when(F.col("own") > 1, F.col("component")).otherwise(-1).alias("of"), F.pmod(F.xxhash64("cid"), "own").alias("block"))
    members = stored(rows.join(total, "key").join(each, ["key", "component"]).select("key", "cid", "component", part.alias("grp")))
    groups = stored(members.groupBy("key", "grp").agg(F.min("component").alias("low"), F.max("component").alias("high")))
    left, right = (groups.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("grp", "low", "high")]) for k in (1, 2))
    one = (F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2"))
    met = stored(left.join(right, "key").where((F.col("grp1") <= F.col("grp2")) & ~one).select("key", "grp1", "grp2"))
    full = members.join(lists.select("key", "cid", "n", "data"), ["key", "cid"])
    sides = [met.where(F.lit(k == 1) | (F.col("grp1") < F.col("grp2"))).join(full.withColumnRenamed("grp", f"grp{k}"), ["key", f"grp{k}"]).select(*names, F.lit(k).alias("side"), "grp1", "grp2") for k in (1, 2)]
    more = stored(sides[0].unionByName(sides[1]).groupBy("key", "grp1", "grp2").applyInPandas(run, "a long, b long"))
    return found if more.isEmpty() else joined(more)[0]


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    component_id is the least doc_id that can be reached over links, itself included; rows link when 100 * intersection
    is at least percent * union of their distinct word shingles. Words are lower-cased (A-Z) runs of bytes other than
    space and 9 to 13. Null texts and texts without words are linked with nothing. Rows and repeated ids are kept, each
    by its own text; other columns are ignored; an empty table gives no rows. No link between different sets is lost.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    key = new_key()
    least = finished(lambda: _class_components(rows, words, percent, key))
    least = least.join(least.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes"), F.max("copies").alias("most")), "component")
    # of all others, the component is the row's own id
    least = stored(least.where((F.col("classes") > 1) | (F.col("most") > 1)).select("class", "component_id"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, sets in _batches(batches, words, key):
            found = pd.DataFrame([(len(own), _name(own)) for own in sets], columns=["n_shingles", "class"])
            yield batch[["doc_id"]].reset_index(drop=True).join(found).astype({"doc_id": "Int64"})

    described = rows.mapInPandas(describe, "doc_id long, n_shingles long, class binary")
    return described.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def new_key() -> bytes:
    """A key of ``shingle_sets``: the driver draws it and hands it to every task, so a task that runs again hashes alike."""
    return secrets.token_bytes(16)


def _batches(batches: Iterator[pd.DataFrame], words: int, key: bytes) -> Iterator[tuple[pd.DataFrame, Iterator[np.ndarray]]]:
    for batch in batches:
        yield batch, shingle_sets(batch["text"].tolist(), words, key)


def _name(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _mark(own: np.ndarray) -> int:
    """A long of which a bounded set can be kept; it alone proves nothing."""
    return int(own[0] ^ own[-1] ^ np.uint64(len(own))) - 2**63 if len(own) else 0


def _class_components(rows: DataFrame, words: int, percent: int, key: bytes) -> DataFrame:
    """(class, cid, unnamed, doc_id, ..., copies, component) of every class: a distinct set of shingles.

    A class stands with its least row, those without an id last. ``rows`` holds doc_id, text and, where an id can stand
    for several texts that must be told apart, their digest.
    """
    keys = [c for c in rows.columns if c != "text"]
    types = dict(rows.dtypes) | {"doc_id": "long"}

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, sets in _batches(batches, words, key):
            out = []
            for own in sets:
                size = _first_size(len(own), percent)
                # some more, as frequent shingles will be put last
                out.append((len(own), _name(own), _mark(own), own[: size + size // 8 + 8].view(np.int64), signature(own).view(np.int64)))
            found = pd.DataFrame(out, columns=["n", "class", "mark", "first", "signs"])
            yield batch[keys].reset_index(drop=True).join(found).astype({"doc_id": "Int64"})[found["n"].to_numpy() > 0]

    described = rows.mapInPandas(describe, ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, class binary, mark long, first array<long>, signs array<long>")
    lowest = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), *keys)).alias("lowest")
    # copies of a set have the same first shingles
    classes = described.groupBy("class").agg(lowest, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "mark", "first", "signs")])
    classes = stored(classes.select("class", "mark", F.monotonically_increasing_id().alias("cid"), "lowest.*", "copies", "n", "first", "signs"))
    postings = finished(lambda: _postings(rows, classes, words, percent, key))
    coarse = finished(lambda: _coarse(postings, classes.select("cid", "n", "signs"), percent))
    wanted = stored(classes.join(coarse, classes["cid"] == coarse["node"]).select("class", "mark", "cid", F.col("component").alias("key")))
    sets = _sets(rows, wanted, words, key)
    none = rows.sparkSession.createDataFrame([], "a long, b long")
    found = finished(lambda: _linked(sets, none, lambda n, a, m, b: similar_pairs(a, b, percent), SETS))
    least = classes.select("class", "cid", "unnamed", *keys, "copies").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    return least.withColumn("component", F.coalesce("component", "cid"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with a count over FREQUENT, MOST_FREQUENT at most, in rising order; and their places by count."""
    least = FREQUENT
    total = 0
    for r in counts.where(F.col("n") > FREQUENT).groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():  # a row a count
        total += r["tokens"]
        if total > MOST_FREQUENT:
            least = r["n"]
            break
    found = counts.where(F.col("n") > least).toPandas()  # MOST_FREQUENT rows at most
    tokens, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    place = np.empty(len(n), np.int64)
    place[np.lexsort((tokens, n))] = np.arange(len(n))
    order = np.argsort(tokens)
    return tokens[order], place[order]


def _postings(rows: DataFrame, classes: DataFrame, words: int, percent: int, key: bytes) -> DataFrame:
    """(token, cid, n): the first shingles of each class that another class has among its own."""
    counts = stored(classes.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    often = rows.sparkSession.sparkContext.broadcast(_frequent(counts))  # 16 bytes for each of MOST_FREQUENT at most

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of all classes but those that have too few rare shingles among those kept: they get one row without a token."""
        for batch in batches:
            tokens, cids, sizes, total = [], [], [], []
            for cid, n, first in zip(batch["cid"], batch["n"], batch["first"], strict=True):
                size = _first_size(n, percent)
                found = _frequent_last(first.view(np.uint64), *often.value, size)
                found = np.zeros(0, np.int64) if found is None else found.view(np.int64)
                tokens.append(found)
                cids.append(cid)
                sizes.append(max(len(found), 1))
                total.append(n)
            if tokens:
                whole = np.repeat([len(t) > 0 for t in tokens], sizes)
                flat = np.concatenate([t if len(t) else np.zeros(1, np.int64) for t in tokens])
                yield pd.DataFrame({"token": flat, "cid": np.repeat(cids, sizes), "n": np.repeat(total, sizes), "short": ~whole})

    schema = "token long, cid long, n long, short boolean"
    picked = classes.select("cid", "n", "first").mapInPandas(pick, schema)
    short = stored(classes.join(picked.where("short").select("cid"), "cid").select("class", "mark", "cid", F.lit(0).cast("long").alias("key")))

    def pick_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, place = often.value
        for batch in batches:
            for cid, n, raw in zip(batch["cid"], batch["n"], batch["data"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                at = np.searchsorted(frequent, own)
                known = (at < len(frequent)) & (frequent[np.minimum(at, max(len(frequent) - 1, 0))] == own) if len(frequent) else np.zeros(len(own), bool)
                order = np.concatenate([own[~known], own[known][np.argsort(place[at[known]])]])
                found = order[: _first_size(n, percent)].view(np.int64)
                yield pd.DataFrame({"token": found, "cid": cid, "n": n})

    more = stored(_sets(rows, short, words, key).mapInPandas(pick_whole, "token long, cid long, n long"))
    # a token that one class alone has is of no use; those of the short classes have not been counted
    shared = counts.select("token").unionByName(more.select("token")).distinct()
    return picked.where("not short").select("token", "cid", "n").join(shared, "token").unionByName(more)


def _differ(a: Column, b: Column) -> Column:
    """The parities in which two signatures differ, the wider one folded; null where their widths are further apart."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), lambda u, v: u.bitwiseXOR(v))
    ones = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, k: s + k)
    return F.when(F.size(a) == F.size(b), ones(a, b)).when(F.size(a) == 2 * F.size(b), ones(half(a), b)).when(2 * F.size(a) == F.size(b), ones(a, half(b)))


def _coarse(postings: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of cids by links that join every two similar classes, and few others."""
    lists = stored(postings.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1"))
    few = stored(postings.join(lists.where(F.col("classes") <= FEW).select("token"), "token"))
    left, right = (few.select("token", F.col("cid").alias(f"cid{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    fits = (F.col("cid1") < F.col("cid2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    pairs = left.join(right, "token").where(fits).select("cid1", "cid2").distinct()
    signs = stored(signs)
    for k in (1, 2):
        pairs = pairs.join(signs.select(F.col("cid").alias(f"cid{k}"), F.col("n").alias(f"n{k}"), F.col("signs").alias(f"signs{k}")), f"cid{k}")
    near = F.coalesce((100 + percent) * _differ(F.col("signs1"), F.col("signs2")) <= (100 - percent) * (F.col("n1") + F.col("n2")), F.lit(True))
    links = stored(pairs.where(near).select(F.col("cid1").alias("a"), F.col("cid2").alias("b")))
    long = stored(lists.where(F.col("classes") > FEW))
    if long.isEmpty():
        return components(links)
    many = postings.join(long, "token")
    # home is the longest list: the classes of one large group are likely to have it in common
    home = many.groupBy("cid").agg(F.max_by("token", F.struct("classes", "token")).alias("home"))

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(signs=[x.tobytes() for x in batch["signs"]]).rename(columns={"signs": "data"})

    signs = signs.mapInPandas(as_bytes, "cid long, n long, data binary")
    many = stored(many.select("token", "cid").join(home, "cid").join(signs, "cid").select(F.col("token").alias("key"), (F.col("token") == F.col("home")).alias("home"), "cid", "n", "data"))
    return _linked(many, links, lambda n, a, m, b: close_pairs(n, a, m, b, percent), SIGNATURES)


def _sets(rows: DataFrame, wanted: DataFrame, words: int, key: bytes) -> DataFrame:
    """(key, home, cid, n, data): the set of each wanted class (class, mark, cid, key).

    Texts never move: each task takes their sets anew, and of those only the ones whose mark is among the wanted go on.
    """
    if wanted.isEmpty():
        return rows.sparkSession.createDataFrame([], "key long, home boolean, cid long, n long, data binary")
    marks = rows.sparkSession.sparkContext.broadcast(key_set(wanted, "mark"))  # of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # copies within a task; it is emptied before it grows large
        for _, sets in _batches(batches, words, key):
            out, size = [], 0
            for own in sets:
                if len(own) and in_key_set(marks.value, np.array([_mark(own)]))[0]:
                    name = _name(own)
                    if name in seen:
                        continue
                    seen.add(name)
                    out.append((name, len(own), own.tobytes()))
                    size += len(own) * 8
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=["class", "n", "data"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["class", "n", "data"])
            if len(seen) > 100_000:
                seen.clear()

    found = rows.select("text").mapInPandas(run, "class binary, n long, data binary")
    return stored(found.join(wanted.drop("mark"), "class").select("key", F.lit(True).alias("home"), "cid", "n", "data").dropDuplicates(["cid"]))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near copies: of each component one row stays, that of the least doc_id.

    Rows are told apart by id and text: of an id's texts the one of the least digest goes first, and rows without an id
    come last. Texts without words are near copies of nothing; of those only repeated rows of an id go.
    """
    digest = lambda text: F.unhex(F.sha2(text, 256))
    rows = ids_and_texts(docs).withColumn("digest", digest(F.col("text")))
    key = new_key()
    least = finished(lambda: _class_components(rows, words, percent, key))
    kept = least.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "digest")).alias("row")).select("row.*")
    wordless = ~F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # one shuffle of the texts: by id and digest, for the look-up and for repeated rows alike
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    whole = docs.select(row.alias("__row"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("__id"), F.coalesce(digest(docs["text"]), F.lit(b"")).alias("__digest"), wordless.alias("__wordless"), docs["doc_id"].isNull().alias("__unnamed"))
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("digest").alias("__digest"), F.lit(True).alias("__kept"))
    joined = whole.where("not (__wordless and __unnamed)").join(kept, ["__id", "__digest"], "left").where("__wordless or __kept")
    named = joined.dropDuplicates(["__id", "__digest"]).select("__row.*")
    return named.unionByName(whole.where("__wordless and __unnamed").select("__row.*"))
