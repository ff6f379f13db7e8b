"""What a run from raw files leaves on disk, and what goes on the way."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from merceris.functions import storage
from merceris.operators import clean, star
from merceris.plans import catalog, retail, runlog
from merceris.plans.gold import Gold
from merceris.sources.adapter import Tables


def shared(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = (str(found.apply(k)) for k in range(found.size()))
    return {name for name in names if name.startswith("shuffle_")}


def files(root):
    return [f"{at}/{name}" for at, _, names in os.walk(root) for name in names if name.startswith("part-")]


def test_a_query_from_raw_files_leaves_the_tables_of_its_run(spark):
    before = set(os.listdir(shared(spark)))
    made = catalog._from_raw(Gold(Tables(spark, SMALL)))
    root = made.root.removeprefix("file://")
    assert set(os.listdir(shared(spark))) - before == {os.path.basename(root)}
    assert sorted(os.listdir(root)) == ["curated", "log", "processed", "raw", "rejected"] and os.listdir(f"{root}/raw") == []


def test_raw_files_are_packed_and_kept_for_other_runs(spark):
    root = catalog._raw_files(Gold(Tables(spark, SMALL)))
    found = files(f"{root.removeprefix('file://')}/raw")
    assert found and all(name.endswith(".gz") for name in found)
    retail.run(spark, root, "run", "2001-09-01", catalog.DATES)
    assert files(f"{root.removeprefix('file://')}/raw") == found


@pytest.mark.parametrize("set_to", [None, "false", "true"])
def test_writes_remove_their_shuffles_and_leave_the_session_as_it_was(spark, tmp_path, set_to):
    before, seen = spark.conf.get(storage.SHUFFLES_GO, None), shuffles(spark)
    spark.conf.unset(storage.SHUFFLES_GO) if set_to is None else spark.conf.set(storage.SHUFFLES_GO, set_to)
    log = runlog.Recorder(spark, f"file://{tmp_path}/log", "run", "zstd")
    grouped = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id").toDF("k", "total")
    again = log.write("again", storage.stored(grouped).join(grouped, ["k", "total"]), "k", f"file://{tmp_path}/again")
    assert sorted(map(tuple, again.collect())) == [(k, sum(range(k, 1000, 7))) for k in range(7)]
    assert shuffles(spark) <= seen
    with pytest.raises(Exception):
        log.write("bad", spark.range(3).selectExpr("raise_error('x') as k"), "k", f"file://{tmp_path}/bad")
    assert spark.conf.get(storage.SHUFFLES_GO, None) == set_to
    spark.conf.unset(storage.SHUFFLES_GO) if before is None else spark.conf.set(storage.SHUFFLES_GO, before)


def test_passing_tables_go_and_others_stay(spark):
    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    own = storage.stored(spark.range(5))
    with storage.passing(spark) as clear:
        first, second = storage.stored(spark.range(6)), storage.stored(spark.range(7))
        paths = [df.inputFiles()[0].removeprefix("file://") for df in (first, second)]
        clear(1)
        assert [os.path.exists(p) for p in paths] == [False, True]
        clear()
        assert not os.path.exists(paths[1])
    kept = storage.stored(spark.range(8))
    assert there(own) and there(kept)


def test_lines_cleaned_in_stages_are_the_same(spark):
    raw = catalog._dirty(Gold(Tables(spark, SMALL)))
    orders, products, staged = clean.clean_orders(raw["orders"], raw["customers"]), clean.clean_products(raw["products"]), []

    def stage(df):
        staged.append(sorted(df.columns))
        return storage.stored(df)

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(clean.clean_order_items(raw["order_items"], orders, products, stage)) == rows(clean.clean_order_items(raw["order_items"], orders, products))
    assert staged == [sorted(raw["order_items"].columns)] * 2


def test_a_failing_stage_is_a_failed_try_of_its_step(spark, monkeypatch):
    broken = lambda df, column: df.withColumn(column, F.when(F.col("order_item_id").isNotNull(), F.raise_error(F.lit("no disk"))).cast("double")) if column == "unit_price" else df
    monkeypatch.setattr(clean, "clip_negative", broken)
    root = catalog._raw_files(Gold(Tables(spark, SMALL)))
    with pytest.raises(Exception, match="no disk"):
        retail.run(spark, root, "run", "2001-09-01", catalog.DATES)
    last = {r["step"]: (r["status"], r["error"]) for r in runlog.read_tries(spark, f"{root}/log").collect()}
    assert last["clean_orders"] == ("SUCCESS", None) and last["clean_order_items"][0] == "FAILED" and "no disk" in last["clean_order_items"][1] and "clean_payments" not in last
    assert [(r["status"], r["failed_steps"]) for r in runlog.read_runs(spark, f"{root}/log").collect()] == [("FAILED", 1)]


def test_purchases_in_stages_are_those_of_the_lines(spark):
    tables, staged = Tables(spark, SMALL), []

    def stage(df):
        staged.append(df.columns)
        return storage.stored(df, "zstd")

    rows = lambda df: sorted(map(str, df.collect()))
    made, plain = retail.StagedGold(tables, "2001-09-01", stage), Gold(tables)
    assert rows(made.purchases()) == rows(plain.purchases())
    assert staged == [["product_id", "quantity", "customer_id"], ["customer_id", "category", "product_name", "quantity"]]
    assert rows(made.favourites()) == rows(plain.favourites())
    plan = made.product_counts()._jdf.queryExecution().toString()
    assert "Join" not in plan  # both joins have ended, and their shuffles are gone, before purchases are dealt to customers


def test_line_facts_in_stages_are_the_same(spark):
    tables, staged = Tables(spark, SMALL), []
    orders = tables.orders().withColumn("order_key", F.crc32("order_id"))
    products = tables.products().where("product_id > 'PROD00000050'").withColumn("product_key", F.crc32("product_id"))

    def stage(df):
        staged.append(sorted(df.columns))
        return storage.stored(df)

    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(star.fact_order_items(tables.order_items(), orders, products, stage)) == rows(star.fact_order_items(tables.order_items(), orders, products))
    assert staged == [["discount", "order_id", "order_item_id", "product_key", "quantity", "unit_price"]]
