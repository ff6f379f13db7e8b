"""Stages that hand rows on keep columns of any name."""

from __future__ import annotations

from pyspark.sql import functions as F

from merceris.llm import repeats


def test_repeats_keep_dotted_columns(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "first " + passage + " end"), (2, "second " + passage), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("a.b"), F.lit(None).cast("string").alias("cover"))
    out = {r["doc_id"]: r for r in repeats.without_repeats(docs, 200).collect()}
    assert set(out) == {1, 2, 3, 4} and all(r["a.b"] == "x" for r in out.values())
    assert passage not in out[1]["text"] and passage not in out[2]["text"] and out[3]["text"] is None
