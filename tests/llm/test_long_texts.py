"""Very long texts and very many matches in one text."""

from __future__ import annotations

import pytest
from conftest import SMALL

pytest.importorskip("public_tokenizers")

from test_operators import brute_repeats, brute_secrets, pairs  # noqa: E402

from merceris.llm import repeats, secret_scan  # noqa: E402


def test_secrets_in_long_texts(spark):
    rows = [(1, "aB3xQ9" * 170_000), (2, "é token=aB3xQ9zzPq8LmN0aB7cD2eFxY9 😀 " * 50_000), (3, "deadbeef" * 3 + " " + "ab cdef012 " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SMALL}/documents.parquet")))
    found = secret_scan.find_secrets(docs, model)
    assert pairs(found.select("doc_id", secret_scan.as_text(found["base"]).alias("base")), "doc_id", "base") == [(d, brute_secrets(t)) for d, t in rows]
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, model).collect()}
    assert masked[1] == "[secret]" and masked[2] == "é [secret] 😀 " * 50_000 and masked[3] == "[secret] " + "ab cdef012 " * 50_000


def test_running_sums_over_several_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    rows = [(list(range(n)),) for n in range(12)]
    df = spark.createDataFrame(rows, "v array<int>").select("v", secret_scan._before(F.col("v"), F.lit(0), lambda a, x: a + x).alias("sums"))
    assert all(r["sums"] == [sum(r["v"][:k]) for k in range(len(r["v"]) + 1)] for r in df.collect())


def test_repeats_in_a_long_text(spark):
    texts = [(1, "".join(chr(97 + (k * k + k // 7) % 26) for k in range(60_000)) + "x" * 300), (2, "y" + "x" * 300), (3, "z" * 100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, 60).collect()]
    assert sorted(found) == brute_repeats(texts, 60)
