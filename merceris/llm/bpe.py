"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

``encode_piece`` keeps, for each live byte position, the rank of the pair that starts there. A segment tree holds the
leftmost position of the least rank; a merge removes one position and updates the leaves of the merged token and of its
live left neighbour, each in O(log n). So one long run without a pattern break costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ids_and_texts, slices

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 500_000
NONE = 1 << 62
#: A key is the rank shifted by so many bits, and the byte position.
SHIFT = 36
PLACE = (1 << SHIFT) - 1

SCHEMA = "doc_id long, n_bytes long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pattern match: always merge the leftmost pair of the least rank. Raises KeyError for an unknown byte."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * width)
    rank = ranks.get
    # a leaf's key is rank and position together, so that the least key is the leftmost pair of the least rank
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << SHIFT | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    least = tree[1]
    while least != NONE:
        i = least & PLACE
        j = after[i]
        end = after[i] = after[j]
        before[end] = i
        left = before[i]
        changed = []
        if j < n - 1:
            tree[width + j] = NONE
            changed.append(width + j)
        if end < n:
            r = rank(piece[i : after[end]])
            tree[width + i] = NONE if r is None else r << SHIFT | i
        else:
            tree[width + i] = NONE
        changed.append(width + i)
        if left >= 0:
            r = rank(piece[left:end])
            tree[width + left] = NONE if r is None else r << SHIFT | left
            changed.append(width + left)
        for k in changed:
            key = tree[k]
            while k > 1:
                other = tree[k ^ 1]
                if other < key:
                    key = other
                k >>= 1
                if tree[k] == key:
                    break
                tree[k] = key
        least = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Text to ids and back, for one vocabulary of ranks (ids are ranks) and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.none = max(ranks.values()) + 1  # the id of no token
        self.byte = np.array([ranks[bytes([c])] for c in range(256)])
        pairs = {ranks[t[:k]] * self.none + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(pairs))
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()])

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree keys of token pairs at places; NONE if no token joins them."""
        want = left * self.none + right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        fits = (self.pairs[at] == want) & (left < self.none) & (right < self.none)
        return np.where(fits, self.merged[at] << SHIFT | place, NONE)

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """encode_piece for many pieces of at most ``width`` bytes (a power of two): a segment tree for each row, in step."""
        m, rows = len(pieces), np.arange(len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, m)
        ids = np.full((m, width + 2), self.none)
        live = np.arange(width) < size[:, None]
        ids[:, :width][live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 3), (m, 1))
        before = np.tile(np.arange(-1, width + 1), (m, 1))
        tree = np.full((m, 2 * width), NONE)
        tree[:, width:] = self.keys(ids[:, :width], ids[:, 1 : width + 1], np.arange(width))
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def put(row: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
            node = place + width
            tree[row, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while True:
            least = tree[rows, 1]
            rows, least = rows[least != NONE], least[least != NONE]
            if not len(rows):
                break
            i = least & PLACE
            j = after[rows, i]
            end = after[rows, j]
            after[rows, i], before[rows, end], ids[rows, i], live[rows, j] = end, i, least >> SHIFT, False
            put(rows, j, NONE)
            put(rows, i, self.keys(ids[rows, i], ids[rows, end], i))
            left = before[rows, i]
            some = left >= 0
            if some.any():
                row, place = rows[some], left[some]
                put(row, place, self.keys(ids[row, place], ids[row, i[some]], place))
        flat, ends = ids[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces."""
        lanes: dict[int, list[tuple[str, bytes]]] = {8: [], 16: [], 32: []}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(raw) > 32:
                self.known[p] = np.array(encode_piece(raw, self.ranks), "<u4").tobytes()
            else:
                lanes[8 if len(raw) <= 8 else 16 if len(raw) <= 16 else 32].append((p, raw))
        for width, own in lanes.items():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                self.known.update(zip([p for p, _ in part], self.encode_many([raw for _, raw in part], width), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        known = self.known
        fresh = {p for own in pieces for p in own if p not in known}
        if fresh and len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = {p for own in pieces for p in own}
        self.learn(fresh)
        return [b"".join([known[p] for p in own]) for own in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again; one row for each document, no shuffle.

    vocabulary: path of a rank file on every executor. Returns doc_id, n_bytes, n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded (bytes); with ``digests`` the two binaries become lowercase SHA-256 strings
    ids_sha256 and decoded_sha256, made in the same task so that they needn't leave it. Null and empty texts have no
    ids. Repeated rows and ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, end in slices(texts):
                rows = []
                for doc, text, ids in zip(batch["doc_id"].iloc[first:end], texts[first:end], own.encode_all(texts[first:end]), strict=True):
                    back, size = own.decode(ids), len(text.encode("utf-8", "surrogatepass"))
                    rows.append((doc, size, len(ids) // 4, *([hashlib.sha256(x).hexdigest() for x in (ids, back)] if digests else (ids, back))))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = SCHEMA if not digests else "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema)
