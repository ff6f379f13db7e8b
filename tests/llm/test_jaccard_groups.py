"""The Jaccard join where groups of similar texts are large, where shingles are frequent, and where words are alike."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from test_operators import brute_components, pairs  # noqa: E402

from merceris.llm import jaccard  # noqa: E402


def alternating(a: str, b: str, n: int) -> tuple[str, str]:
    """Two different words that many polynomial hashes can't tell apart."""
    first = "".join((a, b)[bin(k).count("1") & 1] for k in range(n))
    return first, first.translate(str.maketrans(a + b, b + a))


def test_words_are_told_apart(spark):
    a, b = alternating("a", "n", 2048)
    c, d = alternating("i", "q", 4096)
    sets = list(jaccard.shingle_sets([a, b, c, d, "x" * 63, "x" * 64, "x" * 65, "ab ba", "ba ab"], 3, b"key"))
    assert len({s.tobytes() for s in sets}) == 9
    docs = spark.createDataFrame(list(enumerate([a, b, a])), "doc_id long, text string")
    assert pairs(jaccard.jaccard_components(docs, 3, 90), "doc_id", "component_id") == [(0, 0), (1, 1), (2, 0)]


def test_words_whose_sums_met_under_a_fixed_key_stay_apart(spark):
    a, b = "gmjmkdzpsrvgvxhkyvushhsfrxxzgrkmcujwweycwlvkewynzxcjwyamuyvmkgin", "a" * 64
    docs = spark.createDataFrame([(1, a), (2, b), (3, b), (4, a + "c")], "doc_id long, text string")
    assert pairs(jaccard.jaccard_components(docs, 3, 90), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 2), (4, 4)]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs, 5, 80).collect()) == [1, 2, 4]
    sets = [[s.tobytes() for s in jaccard.shingle_sets([a, b, "a b c"], 3, key)] for key in (b"one", b"two")]
    assert len({*sets[0], *sets[1]}) == 6  # a key's hashes are its own
    assert len({jaccard.new_key() for _ in range(9)}) == 9


def families(seed: int) -> list[tuple[int, str]]:
    """Groups of near copies, chains whose ends are far apart, and texts that hardly differ from a common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = [word() for _ in range(40)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(10, 30)):
            near = list(base)
            near[r.randrange(len(near))] = word()
            texts.append(near)
    chain = [word() for _ in range(80)]
    for _ in range(25):
        chain = list(chain)
        chain[r.randrange(80)] = word()
        texts.append(chain)
    texts += [common + [word() for _ in range(r.randint(0, 12))] for _ in range(40)]
    texts += [[word() for _ in range(r.randint(1, 6))] for _ in range(20)]
    texts += [texts[0]] * 5
    r.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent", "frequent", "few", "block"), [(1, 3, 90, 1, 2, (3, 2000)), (3, 2, 40, 2, 5, (7, 1 << 20))])
def test_large_groups_in_small_blocks(spark, monkeypatch, seed, words, percent, frequent, few, block):
    texts = families(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for name, value in (("FREQUENT", frequent), ("FEW", few), ("SIGNATURES", block), ("SETS", block)):
        monkeypatch.setattr(jaccard, name, value)
    assert pairs(jaccard.jaccard_components(docs, words, percent), "doc_id", "n_shingles", "component_id") == sorted(brute_components(texts, words, percent), key=str)


def test_a_bound_on_frequent_shingles_loses_nothing(spark, monkeypatch):
    texts = families(5)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 20)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert pairs(jaccard.jaccard_components(docs, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(brute_components(texts, 3, 90), key=str)


def test_signatures_never_rule_out_similar_sets():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**64, int(r.integers(0, n // 5 + 1)), np.uint64)]))
        for percent in (30, 60, 80, 90):
            if len(b) and jaccard.similar(a, b, percent):
                sizes = [np.array([len(x)]) for x in (a, b)]
                assert len(jaccard.close_pairs(sizes[0], [jaccard.signature(a)], sizes[1], [jaccard.signature(b)], percent)) == 1


def test_clashing_columns_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 400_000), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("class", "component", "cid", "n", "key", "token", "signs")])
    assert pairs(jaccard.jaccard_components(docs, 3, 90), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_links_of_a_block_lead_to_its_least_class():
    n = 60
    near = np.array([(k, k + 1) for k in range(n - 1)])
    group = pd.DataFrame({"cid": range(n), "component": range(n), "n": 1, "data": b"", "side": 1})
    found = jaccard._edges(group, lambda *_: near)
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(0, k) for k in range(1, n)]


def test_no_link_is_followed_twice(spark, monkeypatch):
    links, known = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda found: links.append(found.count()) or known(found))
    lists = spark.createDataFrame([(7, True, k, 1, np.array([k], np.uint64).tobytes()) for k in range(30)], "key long, home boolean, cid long, n long, data binary")
    every = lambda n, a, m, b: np.argwhere(np.abs(np.concatenate(a).astype(int)[:, None] - np.concatenate(b).astype(int)) < 29)
    found = jaccard._linked(lists, spark.createDataFrame([], "a long, b long"), every, (5, 1 << 20))
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(30)]
    # each link joins two components; later calls don't get those of earlier ones again
    assert len(links) > 1 and sum(links) < 40
