"""Distinct sessions from the stored cube against counts over all events."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from merceris.plans.cube import STEPS, SessionCube

EVENTS = "session_id string, event_timestamp timestamp, device string, traffic_source string, event_type string"


def moment(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def cube(spark, tmp_path):
    return SessionCube(spark, f"file://{tmp_path}/cube")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_keep_sessions_distinct(spark, cube):
    kinds = list(STEPS.values())
    made = [(None if k % 11 == 0 else f"s{k * 7 % 40}", moment(1 + k % 9, k % 24), [None, "mobile", "tablet"][k % 3], ["ads", None][k // 5 % 2], kinds[k * k % 5]) for k in range(400)]
    whole = spark.createDataFrame(made, EVENTS)
    for name, first, end in (("a", 1, 3), ("b", 3, 6), ("a", 1, 3), ("c", 6, 10), ("b", 3, 6)):
        cube.add(name, whole.where((F.dayofmonth("event_timestamp") >= first) & (F.dayofmonth("event_timestamp") < end)))
    numbers = sorted(r["number"] for r in cube.numbers().collect())
    assert numbers == list(range(1, len({r[0] for r in made if r[0]}) + 1))
    distinct = F.count_distinct("session_id")
    assert rows(cube.counts()) == rows(whole.agg(distinct, F.count("*")))
    assert rows(cube.counts([F.col("device")])) == rows(whole.groupBy("device").agg(distinct, F.count("*")))
    late = F.col("day") >= F.lit("2024-01-05").cast("date")
    expected = whole.where(F.dayofmonth("event_timestamp") >= 5).groupBy("traffic_source", "event_type").agg(distinct, F.count("*"))
    assert rows(cube.counts([F.col("traffic_source"), F.col("event_type")], where=late)) == rows(expected)


def test_more_sessions_than_a_block_holds(spark, cube):
    many = spark.range(70_000).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(moment(1)).alias("event_timestamp"), F.lit("tablet").alias("device"), F.lit(None).cast("string").alias("traffic_source"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("page_view").alias("event_type"))
    cube.add("one", many)
    cube.add("two", many.where("session_id < 's2'").withColumn("device", F.lit("mobile")))
    found = cube.counts(measures={"all": None, "bought": F.col("event_type") == "purchase"})
    assert tuple(found.first())[:2] == (70_000, 23_334)
    assert cube.cells().agg(F.max("block")).first()[0] == 3


def test_no_events_at_all(spark, cube):
    cube.add("none", spark.createDataFrame([], EVENTS))
    assert rows(cube.counts()) == [(0, 0)]
    assert rows(cube.counts([F.col("device")])) == []
