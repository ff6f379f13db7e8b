"""Merges into tables stored by ranges: right rows, and no file touched that a change does not meet."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from merceris.sources.ranges import RangedTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    table = RangedTable(spark, f"file://{tmp_path}/t", "k")
    table.create(spark.range(1000).select(F.format_string("K%05d", F.col("id") * 2).alias("k"), F.lit("old").alias("v"), F.col("id").alias("n")), 8)
    return table, f"{tmp_path}/t/data"


def test_only_ranges_that_differ_are_written(spark, stored):
    table, path = stored
    before, folders = files(path), table.folders()
    changes = spark.createDataFrame([("K00010", "new", 5), ("K00012", None, 6), ("K01800", "old", 9), ("K00011", "odd", 0), ("K09999", "far", 1), (None, "x", 2)], "k string, v string, n long")
    done = table.merge(changes, ["v"])
    assert len(done["rewritten"]) == 1 and len(done["added"]) == 2
    assert before.items() <= files(path).items()  # nothing in use has been touched
    assert len(set(folders) & set(table.folders())) == 7
    found = {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}
    assert len(found) == 1002 and table.read().count() == 1002
    assert [found[k] for k in ("K00010", "K00012", "K00011", "K09999", "K01800")] == [("new", 5), ("old", 6), ("odd", 0), ("far", 1), ("old", 900)]
    assert table.read(version=1).count() == 1000 and table.read(version=1).where("v <> 'old'").count() == 0
    after = files(path)
    assert table.merge(changes, ["v"]) == {"rewritten": set(), "added": set()}
    assert files(path) == after


def test_changes_without_insert_and_repeated_changes(spark, stored):
    table, _ = stored
    changes = spark.createDataFrame([("K00010", "b", 5), ("K00010", "a", 5), ("K00011", "odd", 0)], "k string, v string, n long")
    assert table.merge(changes, ["v"], insert=False)["added"] == set()
    assert rows(table.read().where("v <> 'old'")) == [("K00010", "a", 5)]
    assert table.merge(changes.limit(0), ["v"]) == {"rewritten": set(), "added": set()}


def test_empty_tables_and_null_keys(spark, tmp_path):
    table = RangedTable(spark, f"file://{tmp_path}/t", "k", "d")
    table.create(spark.createDataFrame([], "k string, d date, v int"), 4)
    assert table.read().count() == 0
    more = spark.createDataFrame([("a", "2024-01-01", 1), ("b", None, 2), (None, "2024-01-02", 3)], "k string, d string, v int").withColumn("d", F.col("d").cast("date"))
    table.merge(more, ["v"])
    assert rows(table.read().select("k", "v")) == [("a", 1), ("b", 2)]
    other = RangedTable(spark, f"file://{tmp_path}/u", "k", "d")
    other.create(more, 4)
    other.merge(more.withColumn("v", F.col("v") * 10), ["v"])
    assert rows(other.read().select("k", "v")) == [("a", 10), ("b", 20), (None, 3)]
    with pytest.raises(ValueError):
        other.create(more, 0)
