"""Dimensions and facts of the star schema. Tables are built lazily; big parents are never hinted for broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.functions.columns import date_key
from merceris.operators.ranking import dense_key, global_row_number

DEVICES = ("mobile", "desktop", "tablet", "Unknown")
UNKNOWN = "Unknown"


def dim_date(spark: SparkSession, first: str = "2019-01-01", last: str = "2027-12-31") -> DataFrame:
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as full_date")
    return date_columns(days)


def date_columns(days: DataFrame) -> DataFrame:
    """The date dimension's columns of each ``full_date``."""
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.day(d).alias("day"), (F.dayofweek(d) - 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("week"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def dim_location(customers: DataFrame) -> DataFrame:
    places = customers.select("city", "province", "country").dropna().distinct()
    return global_row_number(places, [F.col(c) for c in ("country", "province", "city")], "location_key")


def dim_device(spark: SparkSession) -> DataFrame:
    return spark.sql("select cast(pos + 1 as bigint) device_key, col device_name from (select posexplode(array(" + ",".join(f"'{d}'" for d in DEVICES) + ")))")


def with_full_name(customers: DataFrame) -> DataFrame:
    name = F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    return customers.withColumn("full_name", name)


def dim_customer(customers: DataFrame, locations: DataFrame) -> DataFrame:
    keyed = dense_key(with_full_name(customers), "customer_id", "customer_key")
    return keyed.join(locations, ["city", "province", "country"], "left").select("customer_key", "customer_id", "full_name", "email", "gender", "date_of_birth", "location_key", "registration_date", "customer_status")


def with_margin(products: DataFrame) -> DataFrame:
    price = F.col("selling_price").cast("decimal(12,2)")
    share = (price - F.col("cost").cast("decimal(12,2)")) / price
    return products.withColumn("margin_pct", F.when(price > 0, F.round(share, 4).cast("decimal(6,4)")))


def dim_product(products: DataFrame) -> DataFrame:
    return dense_key(with_margin(products), "product_id", "product_key")


def dim_campaign(campaigns: DataFrame) -> DataFrame:
    return dense_key(campaigns, "campaign_id", "campaign_key")


def lookup(facts: DataFrame, dimension: DataFrame, natural: str, key: str, required: bool = False) -> DataFrame:
    """``facts`` with the surrogate ``key``; rows without one are dropped if it is required.

    Rows with a null natural key are spread by a hash of the whole row, so they don't meet in one task.
    """
    keys = dimension.select(natural, key)
    if required:
        return facts.join(keys, natural)
    spread = facts.withColumn("__salt", F.when(F.col(natural).isNull(), F.xxhash64(*facts.columns)).otherwise(0))
    # always 0, but not a literal, which would be taken out of the join's keys
    keys = keys.withColumn("__salt", F.pmod(F.xxhash64(natural), F.lit(1)))
    return spread.join(keys, [natural, "__salt"], "left").drop("__salt")


def with_line_amount(items: DataFrame) -> DataFrame:
    """Quantity times price less discount, rounded to cents; null if any is null."""
    amount = F.col("quantity") * F.col("unit_price").cast("decimal(12,2)") * (1 - F.col("discount").cast("decimal(5,4)"))
    return items.withColumn("line_amount", F.round(amount, 2).cast("decimal(14,2)"))


def fact_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    keyed = dense_key(orders, "order_id", "order_key")
    return lookup(keyed, customers, "customer_id", "customer_key", True).select("order_key", "order_id", "customer_key", date_key(F.col("order_date")).alias("date_key"), "order_date", "order_status", "payment_method", "total_amount")


def fact_order_items(items: DataFrame, orders: DataFrame, products: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``stage`` may store the lines between the two look-ups, so that the shuffles of one are on disk at a time."""
    # the order last, as in the clean lines: an order's lines stand together
    keyed = lookup(stage(lookup(items, products, "product_id", "product_key").drop("product_id")), orders, "order_id", "order_key", True)
    return with_line_amount(keyed).select("order_item_id", "order_key", "product_key", "quantity", "unit_price", "discount", "line_amount")


def fact_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    return lookup(payments, orders, "order_id", "order_key", True).select("payment_id", "order_key", date_key(F.col("payment_date")).alias("date_key"), "payment_method", "payment_status", "amount")


def fact_tickets(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    return lookup(tickets, customers, "customer_id", "customer_key").select("ticket_id", "customer_key", date_key(F.col("created_at")).alias("date_key"), "issue_type", "priority", "status", "resolution_time")


def fact_interactions(touches: DataFrame, campaigns: DataFrame, customers: DataFrame) -> DataFrame:
    keyed = lookup(lookup(touches, campaigns, "campaign_id", "campaign_key"), customers, "customer_id", "customer_key")
    return keyed.select("interaction_id", "campaign_key", "customer_key", "interaction_type", date_key(F.col("interaction_timestamp")).alias("date_key"))


def fact_events(events: DataFrame, customers: DataFrame, products: DataFrame, devices: DataFrame) -> DataFrame:
    """Events with a time; the device defaults to Unknown; event_year is the partition column."""
    timed = events.where(F.col("event_timestamp").isNotNull()).withColumn("device_name", F.coalesce("device", F.lit(UNKNOWN)))
    keyed = lookup(lookup(timed, customers, "customer_id", "customer_key"), products, "product_id", "product_key")
    keyed = keyed.join(F.broadcast(devices), "device_name", "left")  # four rows
    return keyed.select("event_id", "customer_key", "product_key", "device_key", "session_id", "event_type", "traffic_source", "event_timestamp", F.year("event_timestamp").alias("event_year"))


def load_checks(tables: dict[str, DataFrame], required: dict[str, str]) -> DataFrame:
    """For each table its rows, null required keys, and whether it is fit for use."""
    out = None
    for name, df in tables.items():
        null = F.count_if(F.col(required[name]).isNull()) if name in required else F.lit(0).cast("long")
        part = df.agg(F.count("*").alias("rows"), null.alias("null_keys")).select(F.lit(name).alias("table_name"), "rows", "null_keys")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", (F.col("rows") > 0) & (F.col("null_keys") == 0))
