"""Gold tables: customer profile, RFM, retention and cohorts, lifetime value.

Money is kept in whole cents until it leaves a plan, so sums and ratios are exact on any number of tasks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merceris.functions.columns import cents, half_up, money, month_of, months_between_whole
from merceris.functions.storage import stored
from merceris.operators.ranking import ntiles
from merceris.operators.star import with_full_name, with_line_amount
from merceris.sources.adapter import Tables

LIFESPAN_CAP = 60
RECENT_DAYS = 90


def segment_of(frequency: Column, registered: Column, as_of: Column, r: Column, f: Column, m: Column) -> Column:
    """The nine segments. The order of the cases decides."""
    none = frequency == 0
    cases = [
        (none & (registered >= F.date_sub(as_of, RECENT_DAYS)), "New Customers"),
        (none, "Lost Customers"),
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((f >= 4) & (r >= 3), "Loyal Customers"),
        (f >= 4, "Can't Lose Them"),
        ((f >= 2) & (r <= 2), "At Risk"),
        ((r >= 4) & (f >= 2), "Potential Loyalists"),
        (r >= 4, "New Customers"),
        ((r == 3) & (f <= 2), "Promising"),
        (r == 3, "Need Attention"),
    ]
    out = F.lit("Lost Customers")
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).alias(name)


class Gold:
    """Gold DataFrames over the logical datasets at an explicit date."""

    def __init__(self, tables: Tables, as_of: str = "2001-09-01"):
        self.tables, self.as_of = tables, F.lit(as_of).cast("date")

    @cached_property
    def orders(self) -> DataFrame:
        # an inner join: orders without a known customer are no facts
        known = self.tables.customers().select("customer_id")
        return self.tables.orders().join(known, "customer_id").withColumn("amount", cents(F.col("total_amount"))).withColumn("done", F.col("order_status") == "completed").withColumn("day", F.col("order_date").cast("date"))

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their order's customer and status and their product."""
        items = with_line_amount(self.tables.order_items()).withColumn("line", cents(F.col("line_amount"))).withColumn("gross", cents(F.col("quantity") * F.col("unit_price")))
        products = self.tables.products().select("product_id", "product_name", "category", cents(F.col("cost")).alias("unit_cost"))
        return items.join(self.orders.select("order_id", "customer_id", "done", "day"), "order_id").join(products, "product_id")

    def order_stats(self) -> DataFrame:
        done = F.col("done")
        return self.orders.groupBy("customer_id").agg(
            F.count("*").alias("total_orders"),
            F.count_if(done).alias("completed_orders"),
            F.count_if(F.col("order_status") == "cancelled").alias("cancelled_orders"),
            F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).alias("spend"),
            F.min(F.when(done, F.col("day"))).alias("first_purchase_date"),
            F.max(F.when(done, F.col("day"))).alias("last_purchase_date"),
        )

    def order_months(self) -> DataFrame:
        """The sums of ``order_stats`` by customer and month."""
        done = F.col("done")
        return self.orders.groupBy("customer_id", month_of(F.col("day")).alias("month")).agg(
            F.count("*").alias("total_orders"), F.count_if(done).alias("completed_orders"), F.count_if(F.col("order_status") == "cancelled").alias("cancelled_orders"),
            F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).alias("spend"), F.min(F.when(done, F.col("day"))).alias("first_day"), F.max(F.when(done, F.col("day"))).alias("last_day"),
        )

    def purchases(self) -> DataFrame:
        """What ``product_counts`` takes of the lines."""
        return self.lines.select("customer_id", "category", "product_name", "quantity")

    def product_counts(self) -> DataFrame:
        """n lines and their quantity by customer, category and product; dealt by customer first, so what follows by customer moves no rows."""
        lines = self.purchases()
        # a number that is given stays: tasks put together again would hold the counts of many more customers at once
        dealt = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "customer_id")
        return dealt.groupBy("customer_id", "category", "product_name").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))

    def favourites(self) -> DataFrame:
        """The product of most lines (then of the largest quantity) and the category of the largest quantity of each customer; ties by name."""
        most = lambda c: (F.isnull(c).alias(f"no_{c}"), (-F.col(c)).alias(c))
        product = F.min(F.struct(*most("n"), *most("q"), "product_name")).alias("product")
        found = self.product_counts().groupBy("customer_id", "category").agg(F.sum("q").alias("q"), product)
        product = F.min(F.struct("product", "category")).alias("product")
        found = found.groupBy("customer_id").agg(product, F.min(F.struct(*most("q"), "category")).alias("category"))
        return found.select("customer_id", F.col("product.product.product_name").alias("favorite_product"), F.col("category.category").alias("favorite_category"))

    def favourite_product(self) -> DataFrame:
        return self.favourites().select("customer_id", "favorite_product")

    def favourite_category(self) -> DataFrame:
        return self.favourites().select("customer_id", "favorite_category")

    def web_stats(self) -> DataFrame:
        sessions = self.tables.website_events().groupBy("customer_id", "session_id").agg(F.count("*").alias("n"))
        return sessions.groupBy("customer_id").agg(F.count("session_id").alias("website_sessions"), F.sum("n").alias("website_events"))

    def ticket_stats(self) -> DataFrame:
        hours = cents(F.col("resolution_time"))
        return self.tables.customer_support().groupBy("customer_id").agg(F.count("*").alias("support_tickets"), F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved_tickets"), half_up(F.sum(hours), F.count(hours) * 100, 2).alias("average_resolution_time"))

    def campaign_stats(self) -> DataFrame:
        return self.tables.campaign_interactions().groupBy("customer_id").agg(F.count("*").alias("campaign_interactions"))

    @cached_property
    def people(self) -> DataFrame:
        """What the profile takes from the customers alone."""
        place = F.nullif(F.trim(F.concat_ws(", ", "city", "province")), F.lit(""))
        age = F.call_function("div", months_between_whole(self.as_of, F.col("date_of_birth")), F.lit(12)).cast("long")
        return with_full_name(self.tables.customers()).select("customer_id", F.col("full_name").alias("customer_name"), age.alias("age"), "gender", place.alias("location"), "province", "registration_date")

    @cached_property
    def buying(self) -> DataFrame:
        """The part of the profile that needs customers and orders only; Catalyst can't drop the other joins by itself."""
        months = F.greatest(months_between_whole(self.as_of, F.col("first_purchase_date")), F.lit(1))
        return self.people.join(self.order_stats(), "customer_id", "left").select(
            *self.people.columns, *map(_zero, ("total_orders", "completed_orders", "cancelled_orders", "spend")),
            F.coalesce(half_up(F.col("spend"), F.col("completed_orders") * 100, 2), F.lit(0.0)).alias("average_order_value"),
            "first_purchase_date", "last_purchase_date", F.datediff(self.as_of, "last_purchase_date").cast("long").alias("days_since_last_purchase"),
            F.coalesce(half_up(F.col("completed_orders"), months, 4), F.lit(0.0)).alias("purchase_frequency"),
        )

    @cached_property
    def base_profile(self) -> DataFrame:
        df = self.buying
        for part in (self.favourites(), self.web_stats(), self.ticket_stats(), self.campaign_stats()):
            df = df.join(part, "customer_id", "left")
        return df.select(*self.buying.columns, "favorite_category", "favorite_product", *map(_zero, ("website_sessions", "website_events", "support_tickets", "resolved_tickets")), "average_resolution_time", _zero("campaign_interactions"))

    @cached_property
    def rfm(self) -> DataFrame:
        """Scores of buyers by three NTILE(5) without a global sort, and 1/1/1 for those who never bought."""
        stats = self.tables.customers().select("customer_id", "registration_date").join(self.order_stats(), "customer_id", "left")
        stats = stats.select("customer_id", "registration_date", F.datediff(self.as_of, "last_purchase_date").cast("long").alias("recency_days"), F.coalesce("completed_orders", F.lit(0)).alias("frequency"), F.coalesce("spend", F.lit(0)).alias("spend"))
        buyers = stats.where("frequency > 0")
        scored = ntiles(buyers, "customer_id", {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("spend")}, 5)
        others = stats.where("frequency = 0").select(*stats.columns, *[F.lit(1).alias(c) for c in ("r_score", "f_score", "m_score")])
        every = scored.unionByName(others)
        scores = [F.col(c) for c in ("r_score", "f_score", "m_score")]
        every = every.withColumn("rfm_score", F.concat(*[s.cast("string") for s in scores])).withColumn("rfm_sum", scores[0] + scores[1] + scores[2])
        return every.withColumn("customer_segment", segment_of(F.col("frequency"), F.col("registration_date"), self.as_of, *scores))

    @cached_property
    def buying_profile(self) -> DataFrame:
        """``profile`` without the columns that lines, events, tickets and campaigns give."""
        return self.buying.join(self.rfm.select("customer_id", "rfm_score", "customer_segment"), "customer_id", "left")

    @cached_property
    def profile(self) -> DataFrame:
        return self.base_profile.join(self.rfm.select("customer_id", "rfm_score", "customer_segment"), "customer_id", "left")

    # retention

    def customer_months(self) -> DataFrame:
        return self.orders.where("done").select("customer_id", month_of(F.col("day")).alias("month")).distinct()

    def first_months(self) -> DataFrame:
        return self.customer_months().groupBy("customer_id").agg(F.min("month").alias("cohort_month"))

    def spine(self) -> DataFrame:
        ends = self.customer_months().agg(F.min("month").alias("a"), F.greatest(F.max("month"), month_of(self.as_of)).alias("b"))
        return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("metric_month"))

    def monthly_revenue(self) -> DataFrame:
        return self.orders.where("done").groupBy(month_of(F.col("day")).alias("metric_month")).agg(F.sum("amount").alias("revenue"))

    def month_activity(self) -> DataFrame:
        """active and new customers of each spine month, and how many were active the month before too."""
        months = self.customer_months()
        turn = Window.partitionBy("customer_id").orderBy("month")
        marked = months.withColumn("last", F.lag("month").over(turn))
        flags = marked.groupBy(F.col("month").alias("metric_month")).agg(F.count("*").alias("active"), F.count_if(F.col("last").isNull()).alias("new"), F.count_if(F.col("last") == F.add_months("month", -1)).alias("retained"))
        return self.spine().join(flags, "metric_month", "left").select("metric_month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "new", "retained")])

    @cached_property
    def monthly(self) -> DataFrame:
        now = self.month_activity()
        before = now.select(F.add_months("metric_month", 1).alias("metric_month"), F.col("active").alias("before"))
        df = now.join(before, "metric_month", "left").join(self.monthly_revenue(), "metric_month", "left")
        return df.select(
            "metric_month", F.col("active").alias("active_customers"), F.col("new").alias("new_customers"), (F.col("active") - F.col("new")).alias("returning_customers"),
            half_up(F.col("retained"), F.col("before"), 4).alias("retention_rate"), half_up(F.col("before") - F.col("retained"), F.col("before"), 4).alias("churn_rate"),
            half_up(F.col("active") - F.col("new"), F.col("active"), 4).alias("repeat_purchase_rate"), F.coalesce("revenue", F.lit(0)).alias("revenue"),
        )

    @cached_property
    def cohort(self) -> DataFrame:
        joined = self.customer_months().join(self.first_months(), "customer_id")
        period = ((F.year("month") - F.year("cohort_month")) * 12 + F.month("month") - F.month("cohort_month")).cast("long")
        counted = joined.groupBy("cohort_month", period.alias("period_number")).agg(F.count("*").alias("active_customers"))
        sizes = counted.where("period_number = 0").select("cohort_month", F.col("active_customers").alias("cohort_size"))
        return counted.join(sizes, "cohort_month").select("cohort_month", "period_number", "active_customers", "cohort_size", half_up(F.col("active_customers"), F.col("cohort_size"), 4).alias("retention_rate"))

    # lifetime value

    def mean_churn(self) -> DataFrame:
        """One row: (churn10k, months) with churn in ten-thousandths; no month with churn makes it 1/60."""
        lost = F.round(F.col("churn_rate") * 10000).cast("long")
        return self.monthly.where("churn_rate > 0").agg(F.sum(lost).alias("s"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("s")).otherwise(F.lit(10000)).alias("churn10k"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(LIFESPAN_CAP)).alias("months"))

    def lifespan(self) -> DataFrame:
        """One row: mean_churn and lifespan as the fraction top / bottom of whole numbers, at most the cap."""
        capped = F.col("months") * 10000 > F.col("churn10k") * LIFESPAN_CAP
        return self.mean_churn().select("churn10k", "months", F.when(capped, LIFESPAN_CAP).otherwise(F.col("months") * 10000).alias("top"), F.when(capped, 1).otherwise(F.col("churn10k")).alias("bottom"))

    @cached_property
    def clv(self) -> DataFrame:
        df = self.buying.select("customer_id", "spend", "average_order_value", "purchase_frequency").join(F.broadcast(self.lifespan()))  # one row
        worth = F.round(F.col("average_order_value") * 100).cast("decimal(38,0)") * F.round(F.col("purchase_frequency") * 10000).cast("long") * F.col("top")
        return df.select("customer_id", money(F.col("spend")).alias("historical_clv"), "average_order_value", "purchase_frequency", half_up(F.col("top"), F.col("bottom"), 2).alias("estimated_lifespan_months"), half_up(worth, F.col("bottom") * 1000000, 2).alias("estimated_clv"))

    def profile_view(self) -> DataFrame:
        """Profile and lifetime value. Scores, months and sums ask for the orders many times over, so what they need is stored first."""
        once = GoldOfMonths(self)
        return once.profile.join(once.clv.select("customer_id", "estimated_lifespan_months", "estimated_clv"), "customer_id", "left")


def stats_of_months(months: DataFrame) -> DataFrame:
    """``order_stats`` from order sums by customer and month."""
    total = [F.sum(c).alias(c) for c in ("total_orders", "completed_orders", "cancelled_orders", "spend")]
    return months.groupBy("customer_id").agg(*total, F.min("first_day").alias("first_purchase_date"), F.max("last_day").alias("last_purchase_date"))


class GoldOfMonths(Gold):
    """The gold tables of ``whole`` after one pass over its orders: their sums by customer and month, and by customer, are stored."""

    def __init__(self, whole: Gold):
        super().__init__(whole.tables)
        self.whole, self.as_of = whole, whole.as_of
        self.months = stored(whole.order_months())
        self.stats = stored(stats_of_months(self.months))

    @cached_property
    def people(self) -> DataFrame:
        return self.whole.people

    def order_stats(self) -> DataFrame:
        return self.stats

    def product_counts(self) -> DataFrame:
        return self.whole.product_counts()

    def web_stats(self) -> DataFrame:
        return self.whole.web_stats()

    def ticket_stats(self) -> DataFrame:
        return self.whole.ticket_stats()

    def campaign_stats(self) -> DataFrame:
        return self.whole.campaign_stats()

    def customer_months(self) -> DataFrame:
        return self.months.where("completed_orders > 0").select("customer_id", "month")

    def monthly_revenue(self) -> DataFrame:
        return self.months.where("completed_orders > 0").groupBy(F.col("month").alias("metric_month")).agg(F.sum("spend").alias("revenue"))
