"""The twenty reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merceris.functions.columns import cents, half_up, money, month_of, percent
from merceris.plans.gold import Gold


def text(day: Column) -> Column:
    return day.cast("string")


def _done(g: Gold) -> DataFrame:
    return g.orders.where("done")


def _with_total(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` beside the sums of some of its columns (one row)."""
    return df.join(F.broadcast(df.agg(*[F.sum(c).alias(f"all_{c}") for c in columns])))


def top_customers(g: Gold, limit: int = 10) -> DataFrame:
    best = g.buying_profile.orderBy(F.desc("spend"), "customer_id").limit(limit)
    return best.select("customer_id", "customer_name", "customer_segment", "total_orders", money(F.col("spend")).alias("revenue"))


def top_products(g: Gold, limit: int = 10) -> DataFrame:
    sold = g.lines.where("done").groupBy("product_id", "product_name", "category").agg(F.sum("quantity").alias("units_sold"), F.sum("line").alias("net"))
    return sold.orderBy(F.desc_nulls_last("net"), "product_id").limit(limit).select("product_id", "product_name", "category", "units_sold", money(F.col("net")).alias("revenue"))


def by_segment(g: Gold) -> DataFrame:
    found = g.buying_profile.groupBy("customer_segment").agg(F.count("*").alias("customer_count"), F.sum("spend").alias("s"))
    return found.select("customer_segment", "customer_count", money(F.col("s")).alias("total_revenue"), half_up(F.col("s"), F.col("customer_count") * 100, 2).alias("avg_revenue_per_customer"))


def monthly_revenue_trend(g: Gold) -> DataFrame:
    months = _done(g).groupBy(month_of(F.col("day")).alias("month")).agg(F.sum("amount").alias("r"))
    months = months.withColumn("p", F.lag("r").over(Window.orderBy("month")))  # one row a month
    return months.select(text(F.col("month")).alias("month"), money(F.col("r")).alias("revenue"), money(F.col("p")).alias("prev_month_revenue"), percent(F.col("r") - F.col("p"), F.col("p")).alias("mom_growth_pct"))


def retention_trend(g: Gold, months: int = 12) -> DataFrame:
    moving = Window.orderBy("metric_month").rowsBetween(-2, 0)
    rate = F.round(F.col("retention_rate") * 10000).cast("long")
    df = g.monthly.withColumn("s", F.sum(rate).over(moving)).withColumn("n", F.count(rate).over(moving))
    df = df.orderBy(F.desc("metric_month")).limit(months)
    return df.select(text(F.col("metric_month")).alias("metric_month"), "active_customers", "retention_rate", half_up(F.col("s"), F.col("n") * 10000, 4).alias("retention_rate_3mo_avg"))


def lost_customers(g: Gold) -> DataFrame:
    reason = F.when(F.col("total_orders") == 0, "Never purchased").when(F.col("days_since_last_purchase") > 365, "Inactive > 1 year").otherwise("Inactive 90-365 days")
    lost = g.buying_profile.where(F.col("customer_segment") == "Lost Customers")
    return lost.select("customer_id", "customer_name", "total_orders", money(F.col("spend")).alias("total_spend"), text(F.col("last_purchase_date")).alias("last_purchase_date"), "days_since_last_purchase", reason.alias("churn_reason"))


def at_risk(g: Gold) -> DataFrame:
    mean = g.order_stats().where("total_orders > 0").agg(F.sum("spend").alias("s"), F.count("*").alias("n"))
    rows = g.rfm.where(F.col("customer_segment").isin("At Risk", "Can't Lose Them")).join(F.broadcast(mean))  # one row
    named = rows.join(g.tables.customers().select("customer_id", "first_name", "last_name"), "customer_id")
    over = F.col("spend").cast("decimal(38,0)") * F.col("n") > F.col("s")
    return named.select("customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"), "customer_segment", "recency_days", "frequency", money(F.col("spend")).alias("monetary"), over.alias("above_average_spender"))


def average_order_value(g: Gold) -> DataFrame:
    months = _done(g).groupBy(month_of(F.col("day")).alias("month")).agg(F.sum("amount").alias("s"), F.count("*").alias("order_count"))
    months = months.withColumn("v", half_up(F.col("s"), F.col("order_count"), 0).cast("long"))
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    months = months.withColumn("a", F.sum("v").over(run)).withColumn("b", F.count("*").over(run))
    return months.select(text(F.col("month")).alias("month"), money(F.col("v")).alias("avg_order_value"), "order_count", half_up(F.col("a"), F.col("b") * 100, 2).alias("running_avg_aov"))


def repeat_rate(g: Gold) -> DataFrame:
    n = F.col("completed_orders")
    found = g.order_stats().agg(F.count_if(n >= 2).alias("repeat_customers"), F.count_if(n >= 1).alias("all_purchasers"))
    return found.withColumn("repeat_purchase_rate", half_up(F.col("repeat_customers"), F.col("all_purchasers"), 4))


def by_province(g: Gold) -> DataFrame:
    placed = _done(g).join(g.tables.customers().select("customer_id", "province"), "customer_id")
    found = placed.groupBy("province", "customer_id").agg(F.sum("amount").alias("r")).groupBy("province").agg(F.count("*").alias("customers"), F.sum("r").alias("r"))
    return _with_total(found, "r").select("province", "customers", money(F.col("r")).alias("revenue"), percent(F.col("r"), F.col("all_r")).alias("pct_of_total_revenue"))


def by_category(g: Gold) -> DataFrame:
    found = g.lines.where("done").groupBy("category").agg(F.sum("line").alias("r"))
    return found.withColumn("revenue_rank", F.rank().over(Window.orderBy(F.desc_nulls_last("r"))).cast("long")).select("category", money(F.col("r")).alias("net_revenue"), "revenue_rank")


def sign_ups(g: Gold) -> DataFrame:
    months = g.tables.customers().groupBy(month_of(F.col("registration_date")).alias("m")).agg(F.count("*").alias("new_customers"))
    run = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return months.select(text(F.col("m")).alias("month"), "new_customers", F.sum("new_customers").over(run).alias("cumulative_customers"))


def clv_buckets(g: Gold) -> DataFrame:
    v = F.round(F.col("estimated_clv") * 100).cast("long")
    name = F.when(v == 0, "0 (no purchases)").when(v < 100000, "1 - 999").when(v < 500000, "1,000 - 4,999").when(v < 2000000, "5,000 - 19,999").otherwise("20,000+")
    found = g.clv.groupBy(name.alias("clv_bucket")).agg(F.count("*").alias("customer_count"), F.sum(v).alias("s"))
    return found.select("clv_bucket", "customer_count", half_up(F.col("s"), F.col("customer_count") * 100, 2).alias("avg_clv_in_bucket"))


def score_means(g: Gold) -> DataFrame:
    names = ("r_score", "f_score", "m_score", "rfm_sum")
    found = g.rfm.groupBy("customer_segment").agg(F.count("*").alias("customer_count"), *[F.sum(c).alias(c) for c in names])
    return found.select("customer_segment", "customer_count", *[half_up(F.col(c), F.col("customer_count"), 2).alias(f"avg_{c}") for c in names])


def campaign_performance(g: Gold) -> DataFrame:
    kind = F.col("interaction_type")
    touches = g.tables.campaign_interactions().groupBy("campaign_id").agg(*[F.count_if(kind == k).alias(f"{k}s") for k in ("impression", "click", "conversion")])
    df = g.tables.marketing_campaigns().join(touches, "campaign_id", "left").na.fill(0, ["impressions", "clicks", "conversions"])
    return df.select("campaign_name", "channel", F.col("budget").cast("double").alias("budget"), "impressions", "clicks", "conversions", percent(F.col("clicks"), F.col("impressions")).alias("click_through_rate_pct"), percent(F.col("conversions"), F.col("clicks")).alias("conversion_rate_pct"))


def ticket_analysis(g: Gold) -> DataFrame:
    hours = cents(F.col("resolution_time"))
    found = g.tables.customer_support().groupBy("issue_type", "priority").agg(F.count("*").alias("ticket_count"), F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved_count"), F.sum(hours).alias("s"), F.count(hours).alias("n"))
    return found.select("issue_type", "priority", "ticket_count", "resolved_count", percent(F.col("resolved_count"), F.col("ticket_count")).alias("resolution_rate_pct"), half_up(F.col("s"), F.col("n") * 100, 2).alias("avg_resolution_hours"))


def session_flags(g: Gold) -> DataFrame:
    kind = F.col("event_type")
    steps = {"seen": "page_view", "viewed_product": "product_view", "added_to_cart": "add_to_cart", "started_checkout": "checkout_start", "purchased": "purchase"}
    return g.tables.website_events().groupBy("session_id").agg(*[F.max((kind == v).cast("int")).alias(k) for k, v in steps.items()])


def funnel(g: Gold) -> DataFrame:
    names = ("viewed_product", "added_to_cart", "started_checkout", "purchased")
    found = session_flags(g).agg(F.count("*").alias("total_sessions"), *[F.sum(c).alias(c) for c in names])
    share = lambda a, b, name: percent(F.col(a), F.col(b)).alias(name)
    return found.select("*", share("added_to_cart", "viewed_product", "view_to_cart_pct"), share("purchased", "started_checkout", "checkout_to_purchase_pct"), share("purchased", "total_sessions", "overall_conversion_pct"))


def devices(g: Gold) -> DataFrame:
    named = g.tables.website_events().withColumn("device_name", F.coalesce("device", F.lit("Unknown")))
    # one row a device and session first, so that no distinct count is needed
    sessions = named.groupBy("device_name", "session_id").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    found = sessions.groupBy("device_name").agg(F.count("*").alias("sessions"), F.sum("n").alias("total_events"), F.sum("bought").alias("converting_sessions"))
    return found.withColumn("conversion_rate_pct", percent(F.col("converting_sessions"), F.col("sessions")))


def profitability(g: Gold, limit: int = 10) -> DataFrame:
    sums = g.lines.where("done").groupBy("customer_id").agg(F.coalesce(F.sum("line"), F.lit(0)).alias("r"), F.coalesce(F.sum(F.col("quantity") * F.col("unit_cost")), F.lit(0)).alias("c"))
    # the best few first; the rank is then taken on those rows only
    best = sums.withColumn("p", F.col("r") - F.col("c")).orderBy(F.desc("p"), "customer_id").limit(limit)
    best = best.withColumn("profitability_rank", F.rank().over(Window.orderBy(F.desc("p"))).cast("long"))
    names = g.tables.customers().select("customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"))
    return best.join(names, "customer_id").select("customer_id", "customer_name", money(F.col("r")).alias("revenue"), money(F.col("c")).alias("cost_of_goods"), money(F.col("p")).alias("gross_profit"), percent(F.col("p"), F.col("r")).alias("gross_margin_pct"), "profitability_rank")


def contribution(g: Gold) -> DataFrame:
    found = g.rfm.groupBy("customer_segment").agg(F.count("*").alias("customer_count"), F.sum("spend").alias("r"))
    run = Window.orderBy(F.desc("r"), "customer_segment").rowsBetween(Window.unboundedPreceding, 0)
    df = _with_total(found.withColumn("t", F.sum("r").over(run)), "customer_count", "r")
    return df.select("customer_segment", "customer_count", percent(F.col("customer_count"), F.col("all_customer_count")).alias("pct_of_customers"), money(F.col("r")).alias("revenue"), percent(F.col("r"), F.col("all_r")).alias("pct_of_revenue"), percent(F.col("t"), F.col("all_r")).alias("cumulative_pct_of_revenue"))


REPORTS = {
    "Q01": top_customers, "Q02": top_products, "Q03": by_segment, "Q04": monthly_revenue_trend, "Q05": retention_trend, "Q06": lost_customers, "Q07": at_risk, "Q08": average_order_value, "Q09": repeat_rate, "Q10": by_province,
    "Q11": by_category, "Q12": sign_ups, "Q13": clv_buckets, "Q14": score_means, "Q15": campaign_performance, "Q16": ticket_analysis, "Q17": funnel, "Q18": devices, "Q19": profitability, "Q20": contribution,
}
