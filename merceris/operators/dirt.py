"""Controlled damage to clean tables. Rows are picked by a hash of their key, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merceris.functions.columns import bucket


def picked(salt: str, key: str, rate: float) -> Column:
    return bucket(salt, F.col(key)) < int(round(rate * 10000))


def null_share(df: DataFrame, column: str, key: str, rate: float, salt: str) -> DataFrame:
    return df.withColumn(column, F.when(~picked(salt, key, rate), F.col(column)))


def repeat_share(df: DataFrame, key: str, rate: float, salt: str) -> DataFrame:
    return df.unionByName(df.where(picked(salt, key, rate)))


def break_emails(df: DataFrame, column: str, key: str, rate: float, salt: str) -> DataFrame:
    return df.withColumn(column, F.when(picked(salt, key, rate), F.regexp_replace(column, "@", "_at_")).otherwise(F.col(column)))


def negate_share(df: DataFrame, column: str, key: str, rate: float, salt: str) -> DataFrame:
    return df.withColumn(column, F.when(picked(salt, key, rate), -F.abs(column)).otherwise(F.col(column)))


def orphan_share(df: DataFrame, column: str, key: str, rate: float, salt: str, prefix: str) -> DataFrame:
    stray = F.concat(F.lit(prefix), (F.lit(9000000) + bucket(salt, F.col(key))).cast("string"))
    return df.withColumn(column, F.when(picked(salt, key, rate), stray).otherwise(F.col(column)))


def swap_share(df: DataFrame, first: str, second: str, key: str, rate: float, salt: str) -> DataFrame:
    hit = picked(salt, key, rate)
    swapped = {first: F.when(hit, F.col(second)).otherwise(F.col(first)), second: F.when(hit, F.col(first)).otherwise(F.col(second))}
    return df.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in df.columns])


def dirty_tables(tables, rate: float = 0.02) -> dict[str, DataFrame]:
    """The nine datasets with their usual faults at ``rate``."""
    out = {}
    d = break_emails(tables.customers(), "email", "customer_id", rate, "mail")
    d = repeat_share(d, "customer_id", rate / 2, "twice")
    out["customers"] = null_share(d, "customer_id", "customer_id", rate / 4, "lost")
    out["products"] = swap_share(tables.products(), "cost", "selling_price", "product_id", rate / 3, "swap")
    d = orphan_share(tables.orders(), "customer_id", "order_id", rate, "stray", "CUST")
    d = null_share(d, "order_status", "order_id", rate / 2, "state")
    d = negate_share(d, "total_amount", "order_id", rate / 2, "minus")
    out["orders"] = repeat_share(d, "order_id", rate / 3, "twice")
    d = orphan_share(tables.order_items(), "product_id", "order_item_id", rate, "stray", "PROD")
    out["order_items"] = negate_share(d, "unit_price", "order_item_id", rate / 3, "minus")
    d = null_share(tables.payments(), "payment_status", "payment_id", rate / 2, "state")
    out["payments"] = negate_share(d, "amount", "payment_id", rate / 3, "minus")
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    d = null_share(text(tables.website_events(), "event_id"), "customer_id", "event_id", rate / 3, "who")
    out["website_events"] = null_share(d, "event_type", "event_id", rate / 4, "what")
    d = null_share(text(tables.customer_support(), "ticket_id"), "issue_type", "ticket_id", rate / 3, "issue")
    out["customer_support"] = null_share(d, "customer_id", "ticket_id", rate / 4, "who")
    out["marketing_campaigns"] = tables.marketing_campaigns()
    out["campaign_interactions"] = null_share(text(tables.campaign_interactions(), "interaction_id"), "customer_id", "interaction_id", rate / 3, "who")
    return out
