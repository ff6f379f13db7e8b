"""Spelling variants against brute force: many cells, anagrams, ties, chains, odd tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from merceris.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        met = [v for v in words if near(w, v)]
        best = min(met, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(met), words[best] if form[w] else None)
    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), *rest) for w, rest in out.items())


def rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda r: r[0])


def some_words(seed):
    r = random.Random(seed)
    words = {}
    for _ in range(60):
        start = "".join(r.choice("abcé×") for _ in range(r.randint(1, 9)))
        for k in range(r.randint(1, 8)):
            at = r.randrange(len(start) + 1)
            edited = r.choice([start[:at] + r.choice("abcdÿ") + start[at:], start[:at] + start[at + 1 :], start[:at] + "z" + start[at + 1 :]]) or "a"
            words[edited] = r.choice([2, 2, 20, 200, 2000, 20_000])
        words[start] = r.choice([2, 3, 30, 400])
    words |= {"".join(r.sample("abcdefg", 7)): 2 for _ in range(150)}  # anagrams: one vector
    words |= {"abcdefh": 20, "abcdefgh": 20, "q" * 3_000: 2, "q" * 2_999: 20, "q" * 2_999 + "r": 5}
    return words | {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2_000, "aaabbbb": 20_000, "aabbbbb": 200_000}


@pytest.mark.parametrize(("seed", "cell", "leaf"), [(1, 4_096, 24), (2, 1, 24), (3, 1, 24)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, cell, leaf):
    monkeypatch.setattr(spelling, "CELL", cell)
    words = some_words(seed)
    df = spark.createDataFrame([*words.items(), (None, 3), ("nothing", None)], "word string, n long").repartition(3)
    assert rows(spelling.spelling_variants(df.select("*", F.lit(1).alias("cell"), F.lit("x").alias("best"), F.lit(0).alias("a.b")))) == brute(words)


def test_pairs_in_small_leaves(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 2)
    monkeypatch.setattr(spelling, "AT_ONCE", 50)
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(5)) for _ in range(150)})
    short = sorted({"".join(r.choice("abc") for _ in range(4)) for _ in range(60)})
    for queries, shorter in ((words, False), (short, True)):
        q, m = spelling.near_pairs(spelling.codes(queries, len(queries[0])), spelling.codes(words, 5), shorter)
        assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == [(a, b) for a, x in enumerate(queries) for b, y in enumerate(words) if near(x, y)]


def test_tree_prunes():
    r = np.random.default_rng(1)
    counts = r.integers(0, 3, (4_000, len(spelling.LETTERS))).astype(np.int32)
    tree = spelling.grow(counts, np.arange(4_000), 16)
    one = np.ones(50, np.int64)
    seen = sum(len(leaf) * len(q) for leaf, q in spelling.search(tree, counts, np.arange(50), one, one))
    assert seen < 0.35 * 50 * 4_000


def test_word_counts(spark):
    rows = [(k, t) for k, t in enumerate(["Straße Strasse ÀÉÎÕÜßß", "WORDword wordword-wordword", None, "", "sevenle sevenle SEVENLE", "x" * 100_000, "éééééééé"] * 9)] + [(None, "without id"), (3, "sevenle"), (3, "sevenle")]
    want = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    assert {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=2)


def test_queries_equal_their_sql(spark):
    import duckdb
    from conftest import SMALL

    from merceris.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    for name in ("op11_spelling_variants", "op12_merkle_manifest"):
        got = queries.QUERIES[name](spark, SMALL).toPandas()
        want = con.execute(queries.ORACLES[name]).df()[list(got.columns)]
        plain = lambda f: sorted((tuple(None if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in f.itertuples(index=False)), key=str)
        assert plain(got) == plain(want)
