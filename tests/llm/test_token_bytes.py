"""Token look-ups compare bytes: words whose hashes meet those of tokens."""

from __future__ import annotations

import random

import pytest

P = pytest.importorskip("public_tokenizers")

from merceris.llm import token_counts  # noqa: E402

#: Words built so that their hash is that of another token.
MEETING = (" ptfrdhmobdivsht", " wkevbpfsmnqpyvq", " zfqnnckbjfhtjmis")


def test_words_that_share_a_hash_with_a_token():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.Counter(P.path("byte_bpe_50k.json"))
    meeting = [token_counts.rolled(w.encode()) for w in MEETING]
    assert all(h in set(own.rolled.tolist()) for h in meeting)  # they do meet
    r = random.Random(4)
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(1, 40)))
    texts = [*MEETING, *(f"many{w} here" for w in MEETING), *(" ".join(letters() for _ in range(20)) for _ in range(60))]
    assert own.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_query_frame_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(1, "many ptfrdhmobdivsht here"), (2, "word " * 513), (3, "word " * 512), (4, None), (5, "é" * 2_000), (5, "again"), (None, "x")]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in found), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} == {True, False}
