"""All quality checks from one key index: the same counts as each check asked alone, and each dataset read once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from merceris.operators import quality

COLUMNS = {
    "customers": "customer_id string, email string, customer_status string",
    "orders": "order_id string, customer_id string, order_status string, total_amount decimal(12,2)",
    "order_items": "order_item_id string, order_id string, product_id string, quantity int, unit_price decimal(12,2), discount decimal(4,2)",
    "payments": "payment_id string, order_id string, amount decimal(12,2)",
    "products": "product_id string, cost decimal(12,2), selling_price decimal(12,2)",
    "website_events": "customer_id string",
    "campaign_interactions": "campaign_id string",
    "marketing_campaigns": "campaign_id string",
}


def damaged(spark):
    """Repeated keys with equal and other amounts, null keys on both sides, orphans, a hot order."""
    key = lambda letter, n: F.when(F.col("id") % 13 != 0, F.concat(F.lit(letter), (F.col("id") % n).cast("string")))
    amount = lambda n: F.when(F.col("id") % 17 != 0, (F.col("id") % n - 2)).cast("decimal(12,2)")
    of = lambda n, **columns: spark.range(n).select(*[c.alias(k) for k, c in columns.items()])
    status = F.when(F.col("id") % 3 == 0, "active").when(F.col("id") % 3 == 1, "completed")
    return {
        "customers": of(90, customer_id=key("C", 60), email=F.when(F.col("id") % 2 == 0, "a@b.de").when(F.col("id") % 5 == 0, "bad"), customer_status=status),
        "orders": of(200, order_id=key("O", 150), customer_id=key("C", 80), order_status=status, total_amount=amount(40)),
        "order_items": of(500, order_item_id=key("I", 400), order_id=F.when(F.col("id") % 3 == 0, "O7").otherwise(key("O", 170)), product_id=key("P", 30), quantity=(F.col("id") % 4).cast("int"), unit_price=amount(9), discount=F.when(F.col("id") % 2 == 0, 0.1).cast("decimal(4,2)")),
        "payments": of(300, payment_id=key("Y", 300), order_id=F.when(F.col("id") % 3 == 0, "O7").otherwise(key("O", 160)), amount=amount(40)),
        "products": of(25, product_id=key("P", 25), cost=amount(5), selling_price=amount(7)),
        "website_events": of(150, customer_id=key("C", 70)),
        "campaign_interactions": of(50, campaign_id=key("G", 9)),
        "marketing_campaigns": of(12, campaign_id=key("G", 7)),
    }


def counts(found):
    return {r["check_id"]: (r["total"], r["failed"], r["pass_rate"], r["status"]) for r in found.collect()}


@pytest.mark.parametrize("empty", [(), ("orders",), ("payments", "customers", "products"), tuple(COLUMNS)])
def test_all_checks_together_equal_each_alone(spark, empty):
    tables = damaged(spark) | {name: spark.createDataFrame([], COLUMNS[name]) for name in empty}
    ids = [c[0] for c in quality.CHECKS]
    assert counts(quality.results(tables)) == counts(quality.results(tables, only=ids))


def test_each_dataset_is_read_once(spark, tmp_path):
    stored = {}
    for name, df in damaged(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    index = quality.key_index(stored)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == len(stored) and all(any(f"/{name}/" in f for f in index.inputFiles()) for name in stored)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    found = quality.results(stored)
    assert found.inputFiles() and not any(str(tmp_path) in f for f in found.inputFiles())  # what follows reads the stored index only
    assert counts(found) == counts(quality.results(stored, only=[c[0] for c in quality.CHECKS]))


def test_status_of_the_batch_beside_each_check(spark):
    found = quality.results(damaged(spark))
    rows = quality.summary(found).collect()
    assert len(rows) == 23 and {r["overall"] for r in rows} == {quality.gate(found).first()["overall"]} == {"FAIL"}
    fine = quality.summary(found.where("not critical")).collect()
    assert len(fine) == 2 and {r["overall"] for r in fine} == {"PASS"}


def test_index_holds_only_keys_that_are_referred_to(spark):
    tables = damaged(spark)
    keys = {r["key"] for r in quality.key_index(tables).select("key").distinct().collect()}
    lines = {r[0] for r in tables["order_items"].select("order_item_id").distinct().collect()} - {None}
    assert lines and not keys & lines  # a key for each line would be most of the rows that a task holds
    assert len(quality.key_index(tables).columns) == 6  # an amount, a set of faults: no column for each dataset and check
    again = {r["key"]: r["n"] for r in quality.repeated(tables["order_items"], "order_item_id").collect()}
    assert again and sum(n - 1 for n in again.values()) == counts(quality.results(tables))["DQ08"][1] > 0
