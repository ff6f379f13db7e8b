"""From raw files to reports, and what goes wrong on the way."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_registry import plain

from merceris.plans import catalog, reports, retail, runlog
from merceris.plans.gold import Gold
from merceris.sources import io
from merceris.sources.adapter import Frames, Tables


@pytest.fixture(scope="module")
def gold(spark):
    return Gold(Tables(spark, SMALL))


@pytest.fixture(scope="module")
def made(spark, gold):
    return catalog._from_raw(gold)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_reports_of_a_run_equal_sql_over_cleaned_tables(made):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, report in (("RAW_Q02", reports.top_products), ("RAW_Q19", reports.profitability)):
        assert plain(report(made).toPandas()) == plain(con.execute(catalog.ORACLES[name]).df()), name


def test_stored_gold_is_what_a_build_gives(spark, made):
    fresh = Gold(Frames(spark, made.tables.frames), "2001-09-01")
    for name in retail.STORED:
        assert rows(getattr(made, name)) == rows(getattr(fresh, name)), name
    assert rows(made.buying) == rows(fresh.buying)
    for report in (reports.by_segment, reports.at_risk, reports.clv_buckets, reports.contribution):
        assert rows(report(made)) == rows(report(fresh))


def test_log_names_every_write(spark, made):
    steps = {r["step"]: r["records"] for r in runlog.read_tries(spark, f"{made.root}/log").collect()}
    assert len(steps) == 1 + 11 + 12 + 5 and steps["rejected_values"] == 0
    assert steps["clean_orders"] == made.tables.orders().count() and steps["gold_rfm"] == made.rfm.count()
    assert [r["status"] for r in runlog.read_runs(spark, f"{made.root}/log").collect()] == ["SUCCESS"]


def test_missing_and_empty_sources_are_named(spark, gold):
    root = catalog._raw_files(gold, ("payments",), ("products",))
    with pytest.raises(ValueError, match="payments is missing, products is empty"):
        retail.run(spark, root, "run", "2001-09-01")
    with pytest.raises(Exception):
        spark.read.parquet(f"{root}/log/steps")  # nothing was written


def test_a_failing_step_closes_the_run_as_failed(spark, gold, monkeypatch):
    broken = property(lambda self: self.tables.customers().select(F.raise_error(F.lit("no disk")).cast("string").alias("customer_id")))
    monkeypatch.setattr(Gold, "rfm", broken)
    root = catalog._raw_files(gold)
    with pytest.raises(Exception, match="no disk"):
        retail.run(spark, root, "run", "2001-09-01", catalog.DATES)
    last = {r["step"]: r for r in runlog.read_tries(spark, f"{root}/log").collect()}
    assert last["gold_base_profile"]["status"] == "SUCCESS" and last["gold_rfm"]["status"] == "FAILED" and "gold_monthly" not in last
    assert [(r["status"], r["failed_steps"]) for r in runlog.read_runs(spark, f"{root}/log").collect()] == [("FAILED", 1)]


def test_a_header_that_differs_is_an_error(spark, gold, tmp_path):
    gold.tables.customers().write.option("header", True).csv(f"file://{tmp_path}/c")  # has no phone column
    with pytest.raises(Exception, match="(?i)header"):
        io.read_raw(spark, f"file://{tmp_path}/c", "customers").collect()
    with pytest.raises(Exception, match="(?i)header"):
        io.read_checked(spark, f"file://{tmp_path}/c", "customers")[0].collect()


def test_rejected_values_are_kept_as_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,product_name,category,subcategory,brand,cost,selling_price\nP1,a,b,c,d,1.5,cheap\nP2,a,b,c,d,,2\nP3,a,b\nP4,a,b,c,d,x,y\n,a,b,c,d,1,z\n")
    rows, rejected = io.read_checked(spark, f"file://{tmp_path}/p.csv", "products")
    assert [(r["product_id"], r["cost"], r["selling_price"]) for r in rows.collect()] == [("P1", 1.5, None), ("P2", None, 2.0), ("P3", None, None), ("P4", None, None), (None, 1.0, None)]
    found = sorted(((r["key"], r["column"], r["value"]) for r in rejected.collect()), key=str)
    assert found == sorted([("P1", "selling_price", "cheap"), ("P3", "_bad_line", "P3,a,b"), ("P4", "cost", "x"), ("P4", "selling_price", "y"), (None, "selling_price", "z")], key=str)
    assert all(r["source_file"].endswith("p.csv") and r["dataset"] == "products" for r in rejected.collect())
    (tmp_path / "e.json").write_text('{"event_id": "1", "event_timestamp": "2024-01-01T10:00:00"}\n{"event_id": "2", "event_timestamp": "late"}\nnot json\n')
    rows, rejected = io.read_checked(spark, f"file://{tmp_path}/e.json", "website_events")
    assert rows.count() == 3 and rows.where("event_timestamp is not null").count() == 1
    assert sorted((r["column"], r["value"]) for r in rejected.collect()) == [("_bad_line", "not json"), ("event_timestamp", "late")]
