"""Gold tables, ranking and reports: properties over the small tables, and rankings against plain windows."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from merceris.functions.columns import cents
from merceris.operators import events, quality, ranking, star
from merceris.plans.gold import Gold
from merceris.sources import io
from merceris.sources.adapter import Tables


@pytest.fixture(scope="module")
def gold(spark):
    return Gold(Tables(spark, SMALL))


@pytest.mark.parametrize("buckets", [4, 5, 7])
def test_ntile_is_the_window_ntile(spark, buckets):
    df = spark.range(103).select((F.col("id") * 37 % 50).alias("v"), "id")
    order = [F.col("v"), F.col("id")]
    numbered = ranking.global_row_number(df, order, "at").withColumn("mine", ranking.ntile_of(F.col("at"), F.lit(103), buckets))
    plain = df.withColumn("n", F.ntile(buckets).over(Window.orderBy(*order))).withColumn("r", F.row_number().over(Window.orderBy(*order)))
    assert numbered.join(plain, "id").where("mine <> n or at <> r").count() == 0


def test_ntile_with_fewer_rows_than_buckets(spark):
    df = spark.range(3).withColumn("at", F.col("id") + 1).withColumn("t", ranking.ntile_of(F.col("at"), F.lit(3), 5))
    assert [r["t"] for r in df.orderBy("at").collect()] == [1, 2, 3]


def test_segments_cover_all_customers(gold):
    n = gold.tables.customers().count()
    assert gold.rfm.count() == n and gold.rfm.where("customer_segment is null").count() == 0
    assert gold.profile.count() == n
    assert gold.rfm.where("frequency = 0 and rfm_score <> '111'").count() == 0


def test_retention_and_cohorts(gold):
    months = gold.monthly
    assert months.where("abs(churn_rate + retention_rate - 1) > 1e-9").count() == 0
    assert months.where("new_customers > active_customers").count() == 0
    assert gold.cohort.where("period_number = 0 and retention_rate <> 1").count() == 0
    assert gold.cohort.where("active_customers > cohort_size").count() == 0


def test_lifetime_value_is_zero_without_orders(gold):
    none = gold.base_profile.where("completed_orders = 0").select("customer_id")
    assert gold.clv.join(none, "customer_id").where("estimated_clv <> 0 or historical_clv <> 0").count() == 0


def test_generated_columns(spark):
    df = spark.createDataFrame([(60.0, 100.0), (1.0, 0.0)], "cost double, selling_price double")
    assert [r["margin_pct"] and float(r["margin_pct"]) for r in star.with_margin(df).collect()] == [0.4, None]
    line = spark.createDataFrame([(2, 100.0, 0.05), (1, 1.0, None)], "quantity int, unit_price double, discount double")
    assert [r["line_amount"] and float(r["line_amount"]) for r in star.with_line_amount(line).collect()] == [190.0, None]


def test_batches_are_replaced_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, batch_date string")
    path = f"file://{tmp_path}/t"
    io.replace_batches(df, path)
    io.replace_batches(spark.createDataFrame([(9, "2024-01-02")], "v int, batch_date string"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]
    with pytest.raises(ValueError):
        io.folder("r", "odd", "x")


def test_raw_files_null_bad_values(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,customer_id,order_date,order_status,payment_method,total_amount\nO1,C1,2024-01-01T00:00:00,completed,card,abc\n")
    row = io.read_raw(spark, f"file://{tmp_path}/o.csv", "orders").first()
    assert (row["order_id"], row["total_amount"]) == ("O1", None)


def test_null_keys_are_spread_and_stay(spark):
    facts = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("P"), (F.col("id") % 10).cast("string"))).alias("product_id"), "id")
    keys = spark.createDataFrame([("P0", 1), ("P2", 2), (None, 9)], "product_id string, product_key long")
    found = star.lookup(facts, keys, "product_id", "product_key")
    assert found.columns == ["product_id", "id", "product_key"]
    assert found.count() == 2000 and found.where("product_id is null and product_key is null").count() == 1000
    assert found.where("product_key is not null").count() == 400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = star.lookup(facts, keys, "product_id", "product_key").where("product_id is null").groupBy(F.spark_partition_id()).count().count()
        plan = star.lookup(facts, keys, "product_id", "product_key")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks >= 1 and "hashpartitioning(product_id" in plan and ", __salt" in plan.split("hashpartitioning(product_id", 1)[1].split(")")[0]


def test_events_without_a_session_are_one_session(spark):
    rows = [(1, None, "C1", "mobile", None, "page_view", 10), (2, None, "C2", "mobile", None, "purchase", 40), (3, "S", "C1", None, "direct", "page_view", 5), (4, "S", None, None, "direct", None, 7)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, customer_id string, device string, traffic_source string, event_type string, s long")
    found = {(r["session_id"], r["customer_id"]): (r["event_count"], r["converted"], r["duration_seconds"]) for r in events.session_summary(df.withColumn("event_timestamp", F.timestamp_seconds("s"))).collect()}
    assert found == {(None, "C1"): (2, 1, 30), (None, "C2"): (2, 1, 30), ("S", "C1"): (2, 0, 2), ("S", None): (2, 0, 2)}
    assert events.session_summary(df.where("false").withColumn("event_timestamp", F.timestamp_seconds("s"))).count() == 0


def test_cents_of_doubles_are_rounded(spark):
    df = spark.createDataFrame([(1.15,), (-1.15,), (0.29,), (None,)], "v double")
    assert [r[0] for r in df.select(cents(F.col("v"))).collect()] == [115, -115, 29, None]


def test_chosen_checks_read_only_their_tables(spark):
    orders = spark.createDataFrame([("O1", None), ("O1", "C1")], "order_id string, customer_id string")
    found = {r["check_id"]: r["failed"] for r in quality.results({"orders": orders}, only=["DQ04", "DQ07"]).collect()}
    assert found == {"DQ04": 1, "DQ07": 1}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from merceris.functions.storage import shared_folder

    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(fake("local[2]", None)).startswith("file://")
    with pytest.raises(ValueError):
        shared_folder(fake("yarn", None))


def test_favourites_read_the_lines_once(spark):
    g = Gold(Tables(spark, SMALL))
    plan = g.base_profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation [" in x and "l_orderkey" in x for x in plan.splitlines()) == 1


def test_favourites_by_lines_then_quantity_then_name(spark):
    class Given(Gold):
        @property
        def lines(self):
            rows = [("a", "x", "p", 5), ("a", "x", "q", 1), ("a", "x", "q", 1), ("a", "y", "r", 2), ("b", "x", "q", None), ("b", "y", "p", None), ("c", "y", "p", 3), ("c", "x", "p", 3), ("c", "x", "n", None), ("d", "z", "m", None), ("d", "y", "n", -1)]
            return spark.createDataFrame(rows, "customer_id string, category string, product_name string, quantity int")

    assert {r[0]: tuple(r)[1:] for r in Given(None).favourites().collect()} == {"a": ("q", "x"), "b": ("p", "x"), "c": ("p", "x"), "d": ("n", "y")}


def test_counts_of_ranges_read_one_column(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("a.b c"), F.lit("wide").alias("w"))
    out = ranking.global_row_number(df, [F.col("`a.b c`")], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<__range:bigint>" in plan and "ExistingRDD" not in plan
    assert [r[0] for r in out.orderBy("n").collect()] == sorted(map(str, range(100)))


def test_counts_of_products_stay_dealt_to_all_tasks(spark):
    plan = Gold(Tables(spark, SMALL)).favourite_product()._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "WindowGroupLimit" not in plan
