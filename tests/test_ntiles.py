"""NTILE by selection against the window function."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from merceris.operators import ranking
from merceris.plans.gold import Gold
from merceris.sources.adapter import Tables


def check(spark, rows, buckets):
    df = spark.createDataFrame(rows, "id string, a long, b long").repartition(3)
    got = ranking.ntiles(df, "id", {"x": F.col("a"), "y": -F.col("b")}, buckets)
    plain = lambda v: F.ntile(buckets).over(Window.orderBy(v, "id"))
    want = df.select("*", plain(F.col("a")).alias("x"), plain(-F.col("b")).alias("y"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("buckets", [1, 2, 5, 7])
def test_wide_values_and_many_ties(spark, buckets):
    r = random.Random(buckets)
    wide = lambda: r.choice([0, 1, -1, r.randint(-50, 50), r.randint(-(2**62), 2**62), 2**40 + r.randint(0, 3), -(2**40) - r.randint(0, 3)])
    check(spark, [(f"C{k:05d}", wide(), r.choice([3, 3, 3, 4])) for k in range(700)], buckets)


def test_keys_of_any_kind(spark):
    r = random.Random(9)
    keys = {"", "a", "a\x00", "ab", "é", "😀", "zz", *("".join(r.choice("ab\x01é") for _ in range(r.randint(1, 14))) for _ in range(200)), *("the same long beginning " + str(k) for k in range(150))}
    check(spark, [(k, 5, r.randint(0, 1)) for k in keys], 4)
    check(spark, [("the same long beginning " + str(k), 5, 5) for k in range(90)], 5)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_fewer_rows_than_buckets(spark, n):
    check(spark, [(f"k{k}", k % 2, 7) for k in range(n)], 5)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id string, a long")
    assert ranking.ntiles(df, "id", {"x": F.col("a")}, 5).count() == 0


def test_cells_grow_with_values(spark):
    r = random.Random(2)
    values = sorted({0, 1, -1, 4095, 4096, 4097, 2**63 - 1, -(2**63), *(r.randint(-(2**63), 2**63 - 1) >> r.randint(0, 60) for _ in range(2_000))})
    cells = [x["c"] for x in spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).select("v", ranking._cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cells == sorted(cells) and max(map(abs, cells)) < 64 * 4096


def test_no_job_and_no_global_sort(spark):
    df = spark.createDataFrame([(f"k{k}", k % 9) for k in range(50)], "id string, a long")
    spark.sparkContext.setJobGroup("ntiles", "ntiles")
    ranking.ntiles(df, "id", {"x": F.col("a")}, 5)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("ntiles") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = Gold(Tables(spark, SMALL)).rfm._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
