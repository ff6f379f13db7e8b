"""Cleaning steps, damage and quality checks on small rows with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from merceris.operators import clean, dirt, events, quality


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_null_keys_and_duplicates(spark):
    df = spark.createDataFrame([("A", 1), (None, 2), ("B", 3), ("A", 1), ("B", 2)], "k string, v int")
    assert clean.drop_null_key(df, "k").count() == 4
    assert rows(clean.deduplicate(clean.drop_null_key(df, "k"), ["k"])) == [("A", 1), ("B", 2)]


def test_emails(spark):
    df = spark.createDataFrame([("a@b.com",), ("nope",), (None,)], "email string")
    assert rows(clean.flag_invalid_email(df)) == [("a@b.com", True), (None, False), (None, False)]


def test_amounts_dates_and_values(spark):
    df = spark.createDataFrame([(100.0, dt.date(2024, 1, 1), "a"), (-50.0, dt.date(1901, 1, 1), "x"), (0.0, dt.date(2099, 1, 1), None)], "v double, d date, s string")
    out = clean.keep_values(clean.keep_dates(clean.clip_negative(df, "v"), "d"), "s", ["a"])
    assert rows(out) == [(0.0, None, None), (100.0, dt.date(2024, 1, 1), "a"), (None, None, None)]


def test_orphans_cover_all_rows(spark):
    facts = spark.createDataFrame([("A",), ("B",), (None,), ("A",)], "k string")
    parents = spark.createDataFrame([("A",), ("A",), ("C",)], "k string")
    for small in (False, True):
        good, bad = clean.split_orphans(facts, parents, "k", small)
        assert (good.count(), bad.count()) == (2, 2)


def test_cost_over_price(spark):
    df = spark.createDataFrame([(50.0, 20.0), (5.0, 20.0), (None, 3.0)], "cost double, selling_price double")
    assert rows(clean.null_cost_over_price(df)) == [(5.0, 20.0), (None, 3.0), (None, None)]


def test_damage_repeats_itself(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit("x@y.de").alias("mail"))
    once = dirt.break_emails(df, "mail", "k", 0.1, "s").where("mail = 'x_at_y.de'")
    again = dirt.break_emails(df.repartition(7), "mail", "k", 0.1, "s").where("mail = 'x_at_y.de'")
    assert 120 < once.count() < 280
    assert rows(once) == rows(again)


EVENTS = [("1", "c", "S1", 0, "product_view", "p"), ("2", "c", "S1", 100, "add_to_cart", "p"), ("3", "c", "S1", 300, "purchase", "p"), ("4", "d", "S2", 5, "product_view", "q"), ("5", "d", "S2", 6, "page_view", None), ("6", None, "S3", 9, "page_view", None)]


def event_rows(spark):
    df = spark.createDataFrame(EVENTS, "event_id string, customer_id string, session_id string, s int, event_type string, product_id string")
    return df.select("*", F.timestamp_seconds("s").alias("event_timestamp"), F.lit("mobile").alias("device"), F.lit("direct").alias("traffic_source"))


def test_sessions(spark):
    found = {r["session_id"]: (r["event_count"], r["converted"], r["duration_seconds"]) for r in events.session_summary(event_rows(spark)).collect()}
    assert found == {"S1": (3, 1, 300), "S2": (2, 0, 1), "S3": (1, 0, 0)}


def test_tied_products_share_a_rank(spark):
    assert {r["rank"] for r in events.top_viewed(event_rows(spark), 1).collect()} == {1}
    assert events.top_viewed(event_rows(spark), 1).count() == 2


def tables(spark):
    return {
        "customers": spark.createDataFrame([("C1", "a@b.com", "active"), (None, "bad", "odd"), (None, None, None), ("C1", "c@d.com", "churned")], "customer_id string, email string, customer_status string"),
        "orders": spark.createDataFrame([("O1", "C1", "completed", 10.0), ("O2", "C9", None, -1.0)], "order_id string, customer_id string, order_status string, total_amount double"),
        "order_items": spark.createDataFrame([("I1", "O1", "P1", 1, 10.0, 0.0)], "order_item_id string, order_id string, product_id string, quantity int, unit_price double, discount double"),
        "payments": spark.createDataFrame([("P1", "O1", 10.5)], "payment_id string, order_id string, amount double"),
        "products": spark.createDataFrame([("P1", 5.0, 3.0)], "product_id string, cost double, selling_price double"),
        "website_events": spark.createDataFrame([], "customer_id string"),
        "campaign_interactions": spark.createDataFrame([], "campaign_id string"),
        "marketing_campaigns": spark.createDataFrame([], "campaign_id string"),
    }


def test_quality_counts_and_gate(spark):
    found = quality.results(tables(spark))
    by = {r["check_id"]: r for r in found.collect()}
    assert len(by) == 23
    assert (by["DQ01"]["total"], by["DQ01"]["failed"], by["DQ01"]["pass_rate"]) == (4, 2, 0.5)
    assert by["DQ06"]["failed"] == 1 and by["DQ09"]["failed"] == 2 and by["DQ10"]["failed"] == 2
    assert (by["DQ17"]["total"], by["DQ17"]["failed"]) == (2, 1)
    assert (by["DQ21"]["total"], by["DQ21"]["pass_rate"], by["DQ21"]["status"]) == (0, 1.0, "PASS")
    assert (by["DQ15"]["failed"], by["DQ16"]["failed"], by["DQ23"]["failed"]) == (1, 0, 1)
    assert quality.gate(found).first()["overall"] == "FAIL"
    fine = found.where("check_id in ('DQ03', 'DQ23')")
    assert quality.gate(fine).first()["overall"] == "PASS"  # a failing check that isn't critical
    assert {r["dimension"]: r["checks"] for r in quality.by_dimension(found).collect()} == {"completeness": 5, "uniqueness": 3, "validity": 6, "accuracy": 2, "referential_integrity": 6, "consistency": 1}


def test_one_row_a_key_whatever_the_columns(spark):
    columns = "`a.b` string, k string, `__least` int, v double, d array<int>"
    df = spark.createDataFrame([("x", "A", None, 1.0, [2]), ("x", "A", 3, 1.0, [1]), ("x", "A", 3, 1.0, None), (None, "B", 1, None, None), (None, "B", 1, None, None), ("y", None, 2, 0.5, [1])], columns)
    out = clean.deduplicate(df.repartition(3), ["k"])
    assert out.columns == df.columns
    assert rows(out) == [("x", "A", 3, 1.0, [1]), ("y", None, 2, 0.5, [1]), (None, "B", 1, None, None)]
    assert rows(clean.deduplicate(df, ["k", "a.b"])) == rows(out)
    assert rows(clean.deduplicate(df.select("k"), ["k"])) == [("A",), ("B",), (None,)]
    assert "Window" not in clean.deduplicate(df, ["k"])._jdf.queryExecution().toString()
