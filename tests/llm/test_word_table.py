"""BPE by a table of distinct words against the tokenizers library, and the query's digests."""

from __future__ import annotations

import hashlib
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from merceris.llm import queries, word_table  # noqa: E402

CLASHING = ["stretch", "numbers", "words", "word", "ids", "place", "a.b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts():
    r = random.Random(11)
    odd = ["  ", "\n\n", "\t", "don't", "I'LL", "é", "ß中文", "😀😀", " x", " ", "123", "4½", "...!!", "<|endoftext|>", "<|endoftext|", "a<|endoftext|>b", "  <|endoftext|>  ", "\x00", "İi", "é", "supercalifragilistic", "ptfrdhmobdivsht", " ptfrdhmobdivsht"]
    out = ["".join(r.choice([*odd, "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 12)))]) for _ in range(r.randint(0, 40))) for _ in range(150)]
    return [*out, None, "", " ", "a" * 50_000, "ab " * 40_000, "é" * 3_000, "<|endoftext|>" * 300, out[0], out[0]]


def test_equals_the_library(spark, library):
    rows = [(r, t) for r, t in enumerate(texts())]
    rows += [(3, "another row of the same id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    clashing = df.select("*", *[F.lit(None).cast("int").alias(c) for c in CLASHING])
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        assert back == (text or "").encode()
        want.append((doc, len(ids), ids, back))
    path = P.path("byte_bpe_50k.json")
    got = [(r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in word_table.bpe_by_words(clashing, path, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted(map(tuple, word_table.bpe_by_words(clashing, path, P.PATTERN, digests=True).collect()), key=str)
    assert digests == sorted(((d, n, sha(",".join(map(str, ids)).encode()), sha(b)) for d, n, ids, b in want), key=str)


def test_many_stretches(spark, library, monkeypatch):
    monkeypatch.setattr(word_table, "STRETCH", 40)
    rows = [(k, f"word{k % 7} and {'x' * (k % 50)} again") for k in range(60)]
    found = word_table.bpe_by_words(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {k: library.encode(t).ids for k, t in rows}


def test_empty_table(spark):
    assert word_table.bpe_by_words(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    want = {}
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in queries.op13_bpe_words(spark, SMALL).collect()} == want


def test_words_are_encoded_once_each(spark):
    words = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    plan = word_table.word_codes(words, P.path("byte_bpe_50k.json"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") == 1  # above the distinct words, not pushed below them
    assert physical.index("ArrowEvalPython") < physical.index("Exchange hashpartitioning", physical.index("ArrowEvalPython"))
