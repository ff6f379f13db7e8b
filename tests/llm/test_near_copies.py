"""Near copies among rows with repeated and null ids."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from merceris.llm import jaccard  # noqa: E402


def test_rows_of_repeated_and_null_ids_are_told_apart(spark):
    long = lambda c, *other: " ".join([f"{c}{k}" for k in range(60)] + list(other))
    rows = [(1, long("a")), (2, long("a", "x")), (2, long("b")), (None, long("a", "y")), (None, long("c")), (None, long("c", "z")), (None, long("d")), (None, long("d"))]
    rows += [(7, long("e")), (7, long("e", "x")), (8, ""), (8, ""), (8, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*x, "s", "t") for x in rows], "doc_id long, text string, digest string, component string").repartition(3)
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((d, t[0]) for d, t in found if d is not None and t) == [(1, "a"), (2, "b"), (7, "e")]
    assert sorted(t[0] for d, t in found if d is None and t) == ["c", "d"]
    assert sorted(((d, t) for d, t in found if not t), key=str) == [(8, ""), (8, None), (None, ""), (None, "")]
