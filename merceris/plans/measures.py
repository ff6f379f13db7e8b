"""Measures over a filtered slice, and the data sets of the dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merceris.functions.columns import half_up, money, month_of, percent
from merceris.plans.gold import Gold
from merceris.plans.reports import session_flags


def order_slice(g: Gold) -> DataFrame:
    """Orders with what they can be filtered and grouped by."""
    who = g.tables.customers().select("customer_id", "province", "registration_date").join(g.rfm.select("customer_id", "customer_segment"), "customer_id")
    return g.orders.join(who, "customer_id").withColumn("month", month_of(F.col("day")).cast("string"))


def line_slice(g: Gold) -> DataFrame:
    who = g.tables.customers().select("customer_id", "province").join(g.rfm.select("customer_id", "customer_segment"), "customer_id")
    return g.lines.join(who, "customer_id").withColumn("month", month_of(F.col("day")).cast("string"))


def measure(df: DataFrame, aggregates: dict[str, Column], filters: Sequence[Column] = (), by: Sequence[str] = ()) -> DataFrame:
    """Aggregates of ``df`` under filters, for each group of ``by`` or for the whole slice."""
    for condition in filters:
        df = df.where(condition)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


REVENUE = lambda: money(F.coalesce(F.sum(F.when(F.col("done"), F.col("amount"))), F.lit(0)))
AOV = lambda: half_up(F.sum(F.when(F.col("done"), F.col("amount"))), F.count_if(F.col("done")) * 100, 2)


def _mean(name: str, column: str) -> dict[str, Column]:
    rate = F.round(F.col(column) * 10000).cast("long")
    return {name: half_up(F.sum(rate), F.count(rate) * 10000, 4)}


def _mean_money(name: str, column: str) -> dict[str, Column]:
    value = F.round(F.col(column) * 100).cast("long")
    return {name: half_up(F.sum(value), F.count(value) * 100, 2)}


def total_revenue(g: Gold) -> DataFrame:
    return measure(g.orders, {"total_revenue": REVENUE()})


def total_customers(g: Gold) -> DataFrame:
    return measure(g.tables.customers(), {"total_customers": F.count_distinct("customer_id")})


def active_customers(g: Gold) -> DataFrame:
    return measure(g.tables.customers(), {"active_customers": F.count_distinct("customer_id")}, [F.col("customer_status") == "active"])


def average_order_value(g: Gold) -> DataFrame:
    return measure(g.orders, {"average_order_value": AOV()})


def completed_orders(g: Gold) -> DataFrame:
    return measure(g.orders, {"completed_orders": F.count_if(F.col("done"))})


def historical_clv(g: Gold) -> DataFrame:
    return measure(g.clv, _mean_money("customer_lifetime_value", "historical_clv"))


def estimated_clv(g: Gold) -> DataFrame:
    return measure(g.clv, _mean_money("estimated_clv", "estimated_clv"))


def retention_rate(g: Gold) -> DataFrame:
    return measure(g.monthly, _mean("retention_rate", "retention_rate"))


def churn_rate(g: Gold) -> DataFrame:
    return measure(g.monthly, _mean("churn_rate", "churn_rate"))


def repeat_purchase_rate(g: Gold) -> DataFrame:
    return measure(g.monthly, _mean("repeat_purchase_rate", "repeat_purchase_rate"))


def revenue_growth(g: Gold) -> DataFrame:
    now = g.monthly_revenue()
    before = now.select(F.add_months("metric_month", 1).alias("metric_month"), F.col("revenue").alias("p"))
    return now.join(before, "metric_month", "left").select(F.col("metric_month").cast("string").alias("month"), money(F.col("revenue")).alias("revenue"), percent(F.col("revenue") - F.col("p"), F.col("p")).alias("mom_growth_pct"))


def customer_growth(g: Gold) -> DataFrame:
    days = measure(g.tables.customers(), {"n": F.count("*")}, by=["registration_date"])
    run = Window.orderBy("registration_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return days.select(F.col("registration_date").cast("string").alias("registration_date"), F.sum("n").over(run).alias("customers"))


def revenue_share(g: Gold) -> DataFrame:
    found = measure(g.rfm, {"r": F.sum("spend")}, by=["customer_segment"])
    whole = measure(g.rfm, {"w": F.sum("spend")})
    return found.join(F.broadcast(whole)).select("customer_segment", percent(F.col("r"), F.col("w")).alias("revenue_pct"))


def segment_customers(g: Gold) -> DataFrame:
    return measure(g.rfm, {"customers": F.count_distinct("customer_id")}, by=["customer_segment"])


def cohort_retention(g: Gold) -> DataFrame:
    return measure(g.cohort, _mean("cohort_retention", "retention_rate"), by=["period_number"])


def sessions(g: Gold) -> DataFrame:
    return measure(session_flags(g), {"sessions": F.count("session_id")})


def conversion_rate(g: Gold) -> DataFrame:
    return measure(session_flags(g), {"conversion_rate": half_up(F.sum("purchased"), F.count("session_id"), 4)})


def clv_by_segment(g: Gold) -> DataFrame:
    return measure(g.clv.join(g.rfm.select("customer_id", "customer_segment"), "customer_id"), _mean_money("avg_clv", "estimated_clv"), by=["customer_segment"])


def score_grid(g: Gold) -> DataFrame:
    return measure(g.rfm, {"customers": F.count("*")}, by=["r_score", "f_score", "customer_segment"])


def new_and_returning(g: Gold) -> DataFrame:
    wide = g.monthly.select(F.col("metric_month").cast("string").alias("month"), "new_customers", "returning_customers")
    return wide.unpivot("month", ["new_customers", "returning_customers"], "kind", "customers")


def cohort_matrix(g: Gold, periods: int = 12) -> DataFrame:
    names = {k: f"m{k}" for k in range(periods)}
    wide = g.cohort.groupBy(F.col("cohort_month").cast("string").alias("cohort_month")).pivot("period_number", list(names)).agg(F.max("retention_rate"))
    return wide.select("cohort_month", *[F.col(str(k)).alias(n) for k, n in names.items()])


def whole_cohort_matrix(g: Gold, width: int = 12) -> DataFrame:
    """The matrix over all periods: ``width`` of them a row, from ``first_period`` on; rows without any cell are left out."""
    names = {k: f"m{k}" for k in range(width)}
    at = F.col("period_number") % width
    wide = g.cohort.groupBy(F.col("cohort_month").cast("string").alias("cohort_month"), (F.col("period_number") - at).alias("first_period"))
    wide = wide.agg(*[F.max(F.when(at == k, F.col("retention_rate"))).alias(n) for k, n in names.items()])
    return wide.select("cohort_month", "first_period", *names.values())


def events_by_day(g: Gold) -> DataFrame:
    return g.tables.website_events().groupBy(F.to_date("event_timestamp").cast("string").alias("day"), "event_type").agg(F.count("*").alias("events"))


def five_steps(g: Gold) -> DataFrame:
    names = ["seen", "viewed_product", "added_to_cart", "started_checkout", "purchased"]
    return session_flags(g).agg(*[F.sum(c).alias(c) for c in names]).unpivot([], names, "step", "sessions")


def sessions_by_source(g: Gold) -> DataFrame:
    pairs = g.tables.website_events().select(F.coalesce("traffic_source", F.lit("Unknown")).alias("traffic_source"), "session_id").distinct()
    return measure(pairs, {"sessions": F.count("session_id")}, by=["traffic_source"])


def concentration(g: Gold) -> DataFrame:
    group = F.when(F.col("customer_segment").isin("Champions", "Loyal Customers"), "top").when(F.col("customer_segment") == "Lost Customers", "lost").otherwise("middle")
    found = g.rfm.groupBy(group.alias("value_group")).agg(F.count("*").alias("n"), F.sum("spend").alias("r"))
    whole = found.agg(F.sum("n").alias("wn"), F.sum("r").alias("wr"))
    return found.join(F.broadcast(whole)).select("value_group", percent(F.col("n"), F.col("wn")).alias("pct_of_customers"), percent(F.col("r"), F.col("wr")).alias("pct_of_revenue"))


def repeat_by_activity(g: Gold) -> DataFrame:
    buyers = g.order_stats().where("completed_orders > 0")
    quiet = (F.datediff(g.as_of, "last_purchase_date") > 90).alias("inactive_over_90_days")
    return buyers.groupBy(quiet).agg(F.count("*").alias("customers"), half_up(F.count_if(F.col("completed_orders") >= 2), F.count("*"), 4).alias("repeat_rate"))


def revenue_slice(g: Gold, filters: Sequence[Column] = (), by: Sequence[str] = ("month", "category")) -> DataFrame:
    return measure(line_slice(g).where("done"), {"revenue": money(F.sum("line"))}, filters, by)


def customer_page(g: Gold, customer_id: str) -> DataFrame:
    own = F.col("customer_id") == customer_id
    orders = g.orders.where(own).groupBy("customer_id").agg(F.count("*").alias("orders"), F.max("day").cast("string").alias("last_order"))
    tickets = g.tables.customer_support().where(own).groupBy("customer_id").agg(F.count("*").alias("tickets"))
    page = g.profile_view().where(own).select("customer_id", "customer_name", "customer_segment", "rfm_score", money(F.col("spend")).alias("total_spend"), "estimated_clv")
    return page.join(orders, "customer_id", "left").join(tickets, "customer_id", "left").na.fill(0, ["orders", "tickets"])
