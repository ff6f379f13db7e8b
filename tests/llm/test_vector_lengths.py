"""Nearest neighbours where vectors have different lengths."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from merceris.llm import neighbours  # noqa: E402


def test_vectors_are_compared_within_their_length(spark):
    r = np.random.default_rng(6)
    short, long = ({k: r.normal(size=n).tolist() for k in ks} for n, ks in ((8, range(40)), (12, range(50, 60))))
    rows = [*short.items(), *long.items(), (100, [0.0] * 20), (101, [float("nan")] * 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest_neighbours(df).orderBy("query_id", "rank").collect()
    assert {q: [x["rank"] for x in found if x["query_id"] == q] for q in (0, 50)} == {0: [1, 2, 3, 4, 5], 50: [1, 2, 3, 4, 5]}
    assert all(x["vec_id"] in (short if x["query_id"] == 0 else long) for x in found) and len(found) == 10


def test_an_id_on_several_vectors_counts_once(spark):
    r = np.random.default_rng(8)
    rows = [(k, r.normal(size=8).tolist()) for k in [*range(60), *range(0, 60, 7), 0, 50, 50, 51]] + [(50, r.normal(size=12).tolist()), (0, [0.0] * 4)]
    rows += [rows[50], rows[3], rows[3]]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    for q in (0, 50):
        own = sorted((x["rank"], x["vec_id"], x["score"]) for x in found if x["query_id"] == q)
        assert [x[0] for x in own] == [1, 2, 3, 4, 5] and len({x[1] for x in own}) == 5 and q not in {x[1] for x in own}
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
    again = neighbours.nearest_neighbours(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
