"""Look-ups by parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merceris.functions.columns import half_up, money, month_of
from merceris.plans.gold import Gold


def _profile(df: DataFrame) -> DataFrame:
    return df.select("customer_id", "customer_name", "customer_segment", "rfm_score", "location", "total_orders", "completed_orders", money(F.col("spend")).alias("total_spend"), "average_order_value", "purchase_frequency", "favorite_category", "favorite_product")


def customers(g: Gold, segment: str | None = None, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    df = g.profile
    if segment:
        df = df.where(F.col("customer_segment") == segment)
    if q:
        df = df.where(F.col("customer_id").ilike(f"%{q}%") | F.col("customer_name").ilike(f"%{q}%"))
    return _profile(df.orderBy(F.desc_nulls_last("spend"), "customer_id").offset(offset).limit(limit))


def customer(g: Gold, customer_id: str) -> DataFrame:
    return _profile(g.profile.where(F.col("customer_id") == customer_id))


def customer_orders(g: Gold, customer_id: str, limit: int = 20) -> DataFrame:
    own = g.orders.where(F.col("customer_id") == customer_id).orderBy(F.desc("order_date"), "order_id").limit(limit)
    return own.select("order_id", F.col("day").cast("string").alias("order_date"), "order_status", "payment_method", money(F.col("amount")).alias("total_amount"))


def customer_top_products(g: Gold, customer_id: str, limit: int = 5) -> DataFrame:
    found = g.lines.where(F.col("customer_id") == customer_id).groupBy("product_name", "category").agg(F.count("*").alias("order_count"), F.sum("quantity").alias("total_quantity"))
    return found.orderBy(F.desc("order_count"), F.desc("total_quantity"), "product_name", "category").limit(limit)


def device_counts(g: Gold, customer_id: str | None = None) -> DataFrame:
    events = g.tables.website_events()
    events = events if customer_id is None else events.where(F.col("customer_id") == customer_id)
    return events.groupBy(F.coalesce("device", F.lit("Unknown")).alias("device_name")).agg(F.count("*").alias("event_count"))


def customer_recent_events(g: Gold, customer_id: str, limit: int = 10) -> DataFrame:
    own = g.tables.website_events().where(F.col("customer_id") == customer_id).orderBy(F.desc("event_timestamp"), "event_id").limit(limit)
    return own.select("event_id", F.unix_micros("event_timestamp").alias("event_us"), "event_type", "traffic_source")


def rfm(g: Gold, limit: int = 50, offset: int = 0) -> DataFrame:
    best = g.rfm.orderBy(F.desc("rfm_sum"), "customer_id").offset(offset).limit(limit)
    return best.select("customer_id", "recency_days", "frequency", money(F.col("spend")).alias("monetary"), "r_score", "f_score", "m_score", "rfm_score", "rfm_sum")


def rfm_grid(g: Gold) -> DataFrame:
    return g.rfm.where("frequency > 0").groupBy("r_score", "m_score").agg(F.count("*").alias("customer_count"))


def segments(g: Gold) -> DataFrame:
    found = g.rfm.groupBy("customer_segment").agg(F.count("*").alias("customer_count"), F.sum("spend").alias("s"))
    return found.select("customer_segment", "customer_count", half_up(F.col("s"), F.col("customer_count") * 100, 2).alias("avg_clv"), money(F.col("s")).alias("total_spend"))


def monthly_metrics(g: Gold) -> DataFrame:
    return g.monthly.select(F.col("metric_month").cast("string").alias("metric_month"), "active_customers", "new_customers", "returning_customers", "retention_rate", "churn_rate", "repeat_purchase_rate", money(F.col("revenue")).alias("total_revenue"))


def cohorts(g: Gold) -> DataFrame:
    return g.cohort.withColumn("cohort_month", F.col("cohort_month").cast("string"))


def revenue_by_category(g: Gold) -> DataFrame:
    once = g.lines.where("done").groupBy("category", "order_id").agg(F.sum("gross").alias("r"))
    return once.groupBy("category").agg(F.sum("r").alias("r"), F.count("*").alias("order_count")).select("category", money(F.col("r")).alias("gross_revenue"), "order_count")


def traffic_sources(g: Gold) -> DataFrame:
    return g.tables.website_events().groupBy(F.coalesce("traffic_source", F.lit("Unknown")).alias("traffic_source")).agg(F.count("*").alias("event_count"))


def top_viewed_products(g: Gold, limit: int = 10, first: str | None = None, last: str | None = None) -> DataFrame:
    views = g.tables.website_events().where(F.col("event_type") == "product_view")
    if first:
        views = views.where(F.col("event_timestamp") >= F.lit(first).cast("timestamp"))
    if last:
        views = views.where(F.col("event_timestamp") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    counted = views.groupBy("product_id").agg(F.count("*").alias("n"))
    found = counted.join(g.tables.products().select("product_id", "product_name"), "product_id").groupBy("product_name").agg(F.sum("n").alias("view_count"))
    return found.orderBy(F.desc("view_count"), "product_name").limit(limit)


def events_trend(g: Gold) -> DataFrame:
    return g.tables.website_events().groupBy(month_of(F.col("event_timestamp")).cast("string").alias("month")).agg(F.count("*").alias("event_count"))


def quality_results(found: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    df = found if dataset is None else found.where(F.col("dataset") == dataset)
    return df.orderBy(F.desc("check_id")).limit(limit)
