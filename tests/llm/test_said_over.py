"""Words and lines that a text says over and over: its equal runs are one row each, however often they are said."""

from __future__ import annotations

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_repeats  # noqa: E402

from merceris.llm import repeats  # noqa: E402


def test_equal_runs_of_a_text_are_one_row(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    line = word(150) + "\n"
    said = [" onhe. Is" * 200, line * 30, "a" * 900]
    texts = [(k, word(100) + said[k % 3] + word(100)) for k in range(12)]
    texts += [(12, " alone at" * 40), (13, " onhe. Is" * 7 + word(80)), (14, texts[0][1]), (15, None), (16, word(70))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in repeats.remove_repeats(docs, 60).collect()]
    assert sorted(found, key=str) == sorted(brute_repeats(texts, 60), key=str)

    keyed = repeats._keyed(docs, "doc_id", "text")
    keys = {bytes(x["key"]): x["text"] for x in keyed.collect()}
    rows = {bytes(x["key"]): len(x["cover"]) for x in repeats.repeated_windows(keyed, 60).collect()}
    for key, n in rows.items():
        anchor, mark, *_ = repeats.runs(keys[key].encode(), 60)
        assert n <= len(set(zip(anchor.tolist(), mark.tolist(), strict=True))), "a row for each distinct run, not for each place"
    assert sum(rows.values()) < 0.2 * sum(len(repeats.runs((t or "").encode(), 60)[0]) for _, t in texts)


def test_distinct_runs():
    text, anchor, mark, start = (np.array(x) for x in ([0, 0, 0, 1, 1, 1], [5, 5, 7, 5, 5, 5], [1, 1, 1, 1, 2, 1], [0, 9, 18, 30, 4, 2]))
    first, starts = repeats.distinct_runs(text, anchor, mark, start)
    assert list(zip(first.tolist(), (x.tolist() for x in starts), strict=True)) == [(0, [0, 9]), (2, [18]), (5, [2, 30]), (4, [4])]
    assert repeats.distinct_runs(*(np.zeros(0, np.int64),) * 4)[1] == []
