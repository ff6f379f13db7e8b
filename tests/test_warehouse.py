"""The load plan, the recorder around writes, and versioned refreshes."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from merceris.plans import runlog, warehouse
from merceris.plans.warehouse import Table
from merceris.sources import versions
from merceris.sources.adapter import Tables

SOURCES = ("customers", "products", "orders", "order_items", "payments", "website_events", "customer_support", "marketing_campaigns", "campaign_interactions")


def plan(**needs):
    return {name: Table(tuple(n), lambda t: next(iter(t.values())), "id") for name, n in needs.items()}


def test_order_follows_needs():
    order = warehouse.load_order(warehouse.PLAN, SOURCES)
    assert sorted(order) == sorted(warehouse.PLAN) and len(order) == 12
    for name, table in warehouse.PLAN.items():
        assert all(n in SOURCES or order.index(n) < order.index(name) for n in table.needs)


def test_only_what_is_wanted():
    order = warehouse.load_order(warehouse.PLAN, SOURCES, ["fact_payments"])
    assert set(order) == {"dim_location", "dim_customer", "fact_orders", "fact_payments"} and order[-1] == "fact_payments"


@pytest.mark.parametrize(("needs", "wanted", "said"), [(plan(a=["b"], b=["c"], c=["a"]), None, "need each other"), (plan(a=["a"]), None, "need each other"), (plan(a=["nowhere"]), None, "nowhere is neither"), (plan(a=["source"]), ["b"], "b is neither")])
def test_faulty_plans(needs, wanted, said):
    with pytest.raises(ValueError, match=said):
        warehouse.load_order(needs, ["source"], wanted)


def test_each_table_is_built_once_from_what_was_stored(spark):
    stored, given = [], []

    def build(t):
        given.append({n: df.columns for n, df in t.items()})
        return next(iter(t.values()))

    def store(name, df, key):
        stored.append(name)
        return df.withColumn(f"from_{name}", F.lit(1))

    own = {"c": Table(("a", "b"), build, "id"), "a": Table(("source",), build, "id"), "b": Table(("source", "a"), build, "id")}
    built = warehouse.load({"source": spark.range(3)}, store, own)
    assert stored == ["a", "b", "c"] and given[2] == {"a": ["id", "from_a"], "b": ["id", "from_b"]}
    assert built["c"].columns == ["id", "from_a", "from_c"]


def test_recorder_takes_figures_from_the_write(spark, tmp_path):
    log = runlog.Recorder(spark, f"file://{tmp_path}/log", "run")
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("key"))
    assert log.write("good", rows, "key", f"file://{tmp_path}/good").count() == 100
    with pytest.raises(Exception, match="broken half way"):
        log.write("bad", rows.withColumn("key", F.when(F.col("id") == 77, F.raise_error(F.lit("broken half way"))).otherwise(F.col("key"))), "key", f"file://{tmp_path}/bad")
    log.close()
    assert [tuple(r) for r in runlog.read_runs(spark, log.root).select("status", "steps", "failed_steps", "records", "null_keys").collect()] == [("FAILED", 2, 1, 100, 10)]
    log.write("bad", rows.limit(5), "key", f"file://{tmp_path}/bad")
    log.close()
    tries = {(r["step"], r["attempt"]): r for r in runlog.read_tries(spark, log.root).collect()}
    assert sorted(tries) == [("bad", 1), ("bad", 2), ("good", 1)]
    assert tries["bad", 1]["status"] == "FAILED" and "broken half way" in tries["bad", 1]["error"] and tries["bad", 1]["records"] is None
    assert tries["good", 1]["error"] is None and all(r["started_at"] <= r["ended_at"] for r in tries.values())
    assert [tuple(r) for r in runlog.read_runs(spark, log.root).select("status", "steps", "failed_steps", "records", "null_keys").collect()] == [("SUCCESS", 2, 0, 105, 11)]
    spark.read.schema(runlog.TRIES).parquet(f"{log.root}/steps").coalesce(1).write.parquet(f"{log.root}/repeated")
    spark.read.parquet(f"{log.root}/repeated").write.mode("append").parquet(f"{log.root}/steps")  # an append that came twice
    assert runlog.read_tries(spark, log.root).count() == 3


def test_a_load_leaves_its_log(spark, tmp_path):
    tables = Tables(spark, SMALL)
    sources = {n: getattr(tables, n)() for n in SOURCES}
    log = runlog.Recorder(spark, f"file://{tmp_path}/log", "load")
    built = warehouse.load(sources, log.store(f"file://{tmp_path}/star"))
    log.close()
    steps = {r["step"]: r for r in runlog.read_tries(spark, log.root).collect()}
    assert {n: r["records"] for n, r in steps.items()} == {n: df.count() for n, df in built.items()}
    assert built["fact_orders"].join(built["dim_customer"], "customer_key", "left_anti").count() == 0
    assert built["fact_payments"].join(built["fact_orders"], "order_key", "left_anti").count() == 0
    assert built["fact_orders"].join(built["dim_date"], "date_key", "left_anti").count() == 0


def test_a_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    with pytest.raises(ValueError):
        versions.read(spark, root)
    assert versions.publish(spark.range(10), root) == 1
    old = versions.read(spark, root)
    with pytest.raises(Exception, match="half way"):
        versions.publish(spark.range(50).withColumn("id", F.when(F.col("id") == 49, F.raise_error(F.lit("half way"))).otherwise(F.col("id"))), root)
    assert versions.read(spark, root).count() == 10
    assert versions.publish(spark.range(20), root) == 2
    assert old.count() == 10  # a reader that began before the refresh goes on
    assert [versions.read(spark, root, v).count() for v in (None, 1, 2)] == [20, 10, 20]
    assert sorted((r["version"], r["records"]) for r in versions.versions(spark, root).collect()) == [(1, 10), (2, 20)]
    assert versions.publish(spark.range(0), root) == 3 and versions.read(spark, root).count() == 0
    assert versions.expire(spark, root, keep=2) == 2  # the first version, and what the failed refresh left
    assert versions.read(spark, root, 2).count() == 20
    with pytest.raises(ValueError):
        versions.expire(spark, root, keep=0)
