"""Byte-level BPE encoding and decoding over a table of the corpus's distinct words.

Texts are split into words where they are read. Each stretch of texts numbers its own distinct words, so a text becomes a
row of word numbers and a stretch one row of its words in the order of their numbers. The words of all stretches are
reduced to distinct ones, each is encoded once, and its ids are decoded through a join with the table of pieces. A join by
word brings ids and decoded bytes back to stretch and number, and a cogroup by stretch puts them together text by text.
Both steps are done in slices, of words and then of stretches, so that the shuffle files on disk at a time are those of a slice.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Scope, ids_and_texts, spelt_out

#: Characters of the texts of one stretch. One text may be longer and is then a stretch of its own, or ends one.
STRETCH = 12_000_000
#: Words handed to the encoder at once.
AT_ONCE = 4096
#: Slices of the words and of the stretches.
SLICES = 8


class Vocabulary:
    """What a tokenizer file says: ids of byte pieces, special strings, and the pieces by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        own = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(map(byte.__getitem__, token)): k for token, k in own.items() if token not in self.special}
        made = [own["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or len(self.ids) != len(made) + 256:
            raise ValueError("ids must ascend in the order of merges, and each token must be a byte or made by one merge")
        self.pieces = {k: piece for piece, k in self.ids.items()} | {k: s.encode() for s, k in self.special.items()}


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each file and process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


_encoders: dict[str, bpe.Codec] = {}


def encoder(path: str) -> bpe.Codec:
    """One for each file and process. It is given whole words only."""
    if path not in _encoders:
        _encoders[path] = bpe.Codec(vocabulary(path).ids, r"(?!)")
    return _encoders[path]


#: Of these characters most texts are; both libraries of patterns agree on their white space.
PLAIN = "\t\n\v\f\r" + "".join(map(chr, (*range(0x20, 0x7F), *range(0xA1, 0x250))))


class Splitter:
    """The matches of a pattern in a text, by the faster library where the text allows."""

    def __init__(self, pattern: str):
        import re

        import regex

        self.any, self.quick = regex.compile(pattern).findall, re.compile(spelt_out(pattern, PLAIN)).findall
        self.plain = re.compile("[\t-\r\x20-\x7e\xa1-\u024f]*").fullmatch

    def find(self, text: str) -> list[str]:
        return self.quick(text) if self.plain(text) else self.any(text)


class Numbers(dict):
    """A number for each word, given when it is first met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all low bytes first, so that what is stored and moved compresses."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


SPLIT = "slice int, stretch long, doc_id long, numbers binary, first int, words array<string>"


def split_words(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of texts (stretch, doc_id, numbers of their words), in slices 0 to SLICES - 1 by stretch, and after these of a
    stretch's words (stretch, the number of the first, words in order), in slices by the words' CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = Splitter(pattern).find
        special = list(vocabulary(path).special)
        apart = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        part = TaskContext.get().partitionId()
        stretch, numbers, size, texts = part << 32, Numbers(), 0, []
        schema = pa.schema([("slice", pa.int32()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])

        def ended() -> pa.RecordBatch:
            """The stretch's rows. Words are numbered anew, slice by slice."""
            words = list(numbers)
            of = np.fromiter((zlib.crc32(w.encode()) % SLICES for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            anew = np.empty(len(words), np.int64)
            anew[order] = np.arange(len(words))
            ends = np.searchsorted(of[order], np.arange(SLICES + 1)).tolist()
            own = (part + (stretch & 0xFFFF)) % SLICES
            rows = [(own, stretch, doc, planes(anew[found]), None, None) for doc, found in texts]
            rows += [(SLICES + k, stretch, None, None, ends[k], [words[w] for w in order[ends[k] : ends[k + 1]].tolist()]) for k in range(SLICES)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                if apart is None or not any(s in text for s in special):
                    found = find(text)
                else:  # every second part is a special string, which no word equals
                    found = [w for k, own in enumerate(apart(text)) for w in ([own] if k % 2 else find(own))]
                texts.append((doc, np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
                size += len(text) + 64
                if size >= STRETCH:
                    yield ended()
                    stretch, numbers, size, texts = stretch + 1, Numbers(), 0, []
        if texts:
            yield ended()

    return docs.mapInArrow(run, SPLIT)


def word_codes(words: DataFrame, path: str) -> DataFrame:
    """(word, ids, decoded) for each distinct word; one shuffle, by word.

    The join with the pieces keeps the partitioning by word, so putting a word's pieces together moves nothing.
    """

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, codec = vocabulary(path), encoder(path)
        for batch in batches:
            done: list[np.ndarray] = []
            for first in range(0, len(batch), AT_ONCE):
                part = batch.iloc[first : first + AT_ONCE].tolist()
                codec.known.clear()
                codec.learn({w for w in part if w not in own.special})
                done += [np.array([own.special[w]], np.int32) if w in own.special else np.frombuffer(codec.known[w], "<i4") for w in part]
            yield pd.Series(done, index=batch.index, dtype=object)

    pieces = words.sparkSession.createDataFrame([(k, bytearray(p)) for k, p in vocabulary(path).pieces.items()], "id int, piece binary")
    each = words.select("word").distinct().select("word", encoded("word").alias("ids")).select("word", F.posexplode_outer("ids").alias("place", "id"))
    put = each.join(F.broadcast(pieces), "id").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("place", "id", "piece"))).alias("own"))
    return put.select("word", F.col("own.id").alias("ids"), F.reduce("own", F.lit(b""), lambda text, p: F.concat(text, p["piece"])).alias("decoded"))


def _text_slice(stretch: Column) -> Column:
    """The slice of a stretch's texts."""
    return ((F.shiftright(stretch, 32) + stretch.bitwiseAND(F.lit(0xFFFF).cast("long"))) % SLICES).cast("int")


def bpe_by_words(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text through a table of distinct words, and decode its ids through a table of pieces.

    path: a byte-level BPE tokenizer file on every executor; pattern: what splits a text into words. Special strings in a
    text become their ids. Returns doc_id, n_tokens, ids (array of int) and decoded (bytes); with ``digests`` ids_sha256 (of
    the decimal ids joined by commas) and decoded_sha256 in place of the two, made in the same task.

    Null and empty texts have no ids. Repeated rows and ids, null ids among them, are kept as they are. Other columns are
    ignored, whatever their names. An empty table gives no rows. A very long text is one stretch and is held whole by one
    task as word numbers and as words; a very long word is encoded in n log n steps and its ids are one group of the join with the pieces.
    """
    scope = Scope(docs.sparkSession)
    parts = scope.stored(split_words(ids_and_texts(docs, id_col, text_col), path, pattern), ["slice"], "zstd")
    back = []
    for k in range(SLICES):
        listed = parts.where(F.col("slice") == SLICES + k).select("stretch", "first", F.posexplode("words").alias("place", "word"))
        words = listed.select("stretch", (F.col("first") + F.col("place")).alias("number"), "word")
        codes = word_codes(words, path).select("word", F.size("ids").alias("n"), (F.array_join("ids", ",") if digests else F.col("ids")).alias("ids"), "decoded")
        # a partition of a slice's distinct words is small, and hashing it spares sorting both sides by word
        coded = words.join(codes.hint("shuffle_hash"), "word").select("stretch", "number", "n", "ids", "decoded", _text_slice(F.col("stretch")).alias("slice"))
        back.append(scope.stored(coded, ["slice"], "zstd"))
        scope.drop_part(parts, f"slice={SLICES + k}")

    def put(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.take(np.argsort(words["number"].to_numpy()))
        size, decoded, said = words["n"].to_numpy(), np.empty(len(words), object), np.empty(len(words), object)
        decoded[:] = words["decoded"].to_pylist()
        if digests:
            said[:] = [w.encode() for w in words["ids"].to_pylist()]
        else:
            ids = words["ids"].combine_chunks()
            flat, starts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()[:-1]
        rows: list[tuple] = []
        for numbers in texts["numbers"].to_pylist():
            own = from_planes(numbers)
            total = int(size[own].sum())
            if digests:
                shown = b",".join(said[own].tolist()), b"".join(decoded[own].tolist())
                rows.append((total, *(hashlib.sha256(x).hexdigest() for x in shown)))
            else:
                before = np.cumsum(size[own]) - size[own]
                rows.append((total, flat[np.repeat(starts[own] - before, size[own]) + np.arange(total)], b"".join(decoded[own].tolist())))
        types = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.list_(pa.int32()), pa.binary())
        return pa.table([texts["doc_id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    names = [x.split()[0] for x in schema.split(", ")]
    done = []
    for k in range(SLICES):
        texts = parts.where(F.col("slice") == k).select("stretch", "doc_id", "numbers")
        coded = reduce(DataFrame.unionByName, (b.where(F.col("slice") == k).select("stretch", "number", "n", "ids", "decoded") for b in back))
        done.append(scope.stored(texts.groupBy("stretch").cogroup(coded.groupBy("stretch")).applyInArrow(put, schema)))
    scope.keep(*done)
    return reduce(DataFrame.unionByName, done)
