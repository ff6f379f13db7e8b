"""The word memory of packing, and its tokenizer against the library."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from merceris.llm import packing

ODD = ["", " ", "a\x1cb c", "x<|endoftext|>y z", "Ω ΣΑΣ naïve é İx", "don't I'LL 12a34½ ª", "\x00\x01 a\x7fb", "漢字 かな", "a b\x85c　d", "é é", "Ⱥ Ⱦ ɏ", "l'été's ''s\n\n\tx"]


def test_frequent_words_stay_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    own, seen = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json")), Counter()
    theirs = own.model

    class Counting:
        def tokenize(self, word):
            seen[word] += 1
            return theirs.tokenize(word)

    own.model = Counting()
    for k in range(200):
        own.encode(f"common {'abcdefghij'[k % 10] * (1 + k // 10)}")
    assert seen["common"] == 1


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_whole_tokenizer(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.ChunkTokenizer(path).encode(text) == np.array(want, "<u4").tobytes()


def test_pieces_are_made_in_slices(spark):
    docs = spark.createDataFrame([(None if k == 5 else k, f"word {k}" if k % 3 else None) for k in range(600)], "doc_id long, text string").coalesce(1)
    found = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert len(rows) == 600
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert len({(r["length"], r["number"]) for r in rows}) == 600
