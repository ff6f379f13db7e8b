"""How texts reach the statistics."""

import numpy as np

from merceris.llm import quality


def test_texts_reach_the_statistics_in_slices(spark):
    docs = spark.createDataFrame([(k, f"word {k}" if k % 3 else None) for k in range(700)], "doc_id long, text string").coalesce(1)
    found = quality.document_statistics(docs)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()  # it makes all texts of an Arrow batch Python strings at once
    rows = {r["doc_id"]: r["stats"] for r in found.collect()}
    assert len(rows) == 700
    assert np.allclose(rows[699], quality.statistics([None])[0])
    assert np.allclose(rows[400], quality.statistics(["word 400"])[0])
