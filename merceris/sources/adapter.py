"""The nine logical datasets as derived from an order/line/event star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.functions.columns import padded_id


def _pick(number: Column, names: list[str | None], modulus: int) -> Column:
    out = F.lit(None).cast("string")
    for k, name in enumerate(names):
        if name is not None:
            out = F.when(number % modulus == k, name).otherwise(out)
    return out


class Tables:
    """Lazy DataFrames over one folder of Parquet tables; nothing is read until an action runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def customers(self) -> DataFrame:
        place = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        k = F.col("c_custkey")
        return (
            self.raw("customer")
            .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                padded_id("CUST", k).alias("customer_id"),
                F.lit("Customer").alias("first_name"),
                k.cast("string").alias("last_name"),
                F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("email"),
                F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other").alias("gender"),
                F.date_add(F.lit("1955-01-01").cast("date"), (k * 7919 % 18993).cast("int")).alias("date_of_birth"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("province"),
                F.lit("Testland").alias("country"),
                F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 2400).cast("int")).alias("registration_date"),
                F.when(F.col("c_acctbal") < 0, "churned").when(k % 5 == 0, "inactive").otherwise("active").alias("customer_status"),
            )
        )

    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(12,2)")
        return self.raw("part").select(
            padded_id("PROD", F.col("p_partkey")).alias("product_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("subcategory"),
            F.col("p_brand").alias("brand"),
            F.round(price * F.lit("0.6").cast("decimal(3,2)"), 2).cast("decimal(12,2)").alias("cost"),
            price.alias("selling_price"),
        )

    def _status(self, done: str, lost: str) -> Column:
        state = F.col("o_orderstatus")
        return F.when(F.col("o_orderkey") % 20 == 0, "refunded").when(state == "F", done).when(state == "P", lost).otherwise("pending")

    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            padded_id("ORD", F.col("o_orderkey")).alias("order_id"),
            padded_id("CUST", F.col("o_custkey")).alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
            self._status("completed", "cancelled").alias("order_status"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("total_amount"),
        )

    def order_items(self) -> DataFrame:
        # whole cents by whole division: a division of doubles would round in its own way on each engine
        unit = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long"))
        return self.raw("lineitem").select(
            F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("order_item_id"),
            padded_id("ORD", F.col("l_orderkey")).alias("order_id"),
            padded_id("PROD", F.col("l_partkey")).alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (unit.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").alias("unit_price"),
            F.col("l_discount").cast("decimal(5,4)").alias("discount"),
        )

    def payments(self) -> DataFrame:
        k = F.col("o_orderkey")
        more = F.when(k % 50 == 0, 1).otherwise(0)
        return self.raw("orders").select(
            F.concat(F.lit("PAY"), k.cast("string")).alias("payment_id"),
            padded_id("ORD", k).alias("order_id"),
            F.date_add(F.col("o_orderdate").cast("date"), (k * 7 % 4).cast("int")).cast("timestamp").alias("payment_date"),
            F.col("o_orderpriority").alias("payment_method"),
            self._status("success", "failed").alias("payment_status"),
            (F.col("o_totalprice").cast("decimal(14,2)") + more).cast("decimal(14,2)").alias("amount"),
        )

    def _events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    def website_events(self) -> DataFrame:
        user, kind = F.col("user_id"), F.col("event_type")
        named = F.when(kind == "view", "product_view").when(kind == "click", "add_to_cart").when(kind == "signup", "checkout_start").when(kind == "error", "page_view").otherwise("purchase")
        return (
            self._events()
            .withColumn("named", named)
            .select(
                "event_id",
                padded_id("CUST", user).alias("customer_id"),
                F.concat(user.cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string")).alias("session_id"),
                F.col("ts").alias("event_timestamp"),
                F.col("named").alias("event_type"),
                F.when(F.col("named").isin("product_view", "add_to_cart", "purchase"), padded_id("PROD", F.col("k"))).alias("product_id"),
                _pick(user, ["mobile", "desktop", "tablet"], 4).alias("device"),
                _pick(user, ["organic_search", "paid_search", "social_media", "direct", "email", "affiliate"], 7).alias("traffic_source"),
            )
        )

    def customer_support(self) -> DataFrame:
        state = _pick(F.col("event_id"), ["open", "in_progress", "resolved", "closed"], 4)
        value = F.col("value")
        return (
            self._events()
            .where(F.col("event_type") == "error")
            .select(
                F.col("event_id").alias("ticket_id"),
                padded_id("CUST", F.col("user_id")).alias("customer_id"),
                F.col("ts").alias("created_at"),
                _pick(F.col("k"), ["delivery_delay", "product_defect", "refund_request", "general_inquiry"], 4).alias("issue_type"),
                F.when(value >= 100, "urgent").when(value >= 50, "high").when(value >= 20, "medium").otherwise("low").alias("priority"),
                state.alias("status"),
                F.when(state.isin("resolved", "closed"), value.cast("decimal(10,2)")).alias("resolution_time"),
            )
        )

    def marketing_campaigns(self) -> DataFrame:
        n = F.col("n_nationkey")
        first = F.lit("2024-01-01").cast("date")
        return (
            self.raw("nation")
            .where(n <= 12)
            .select(
                F.concat(F.lit("CMP"), F.lpad(n.cast("string"), 3, "0")).alias("campaign_id"),
                F.concat(F.lit("Campaign "), F.col("n_name")).alias("campaign_name"),
                F.when(n % 3 == 0, "email").when(n % 3 == 1, "social_media").otherwise("search_ads").alias("channel"),
                first.alias("start_date"),
                F.date_add(first, (n + 3).cast("int")).alias("end_date"),
                ((n + 1) * 1000).cast("decimal(14,2)").alias("budget"),
            )
        )

    def campaign_interactions(self) -> DataFrame:
        kind = F.col("event_type")
        return (
            self._events()
            .where(kind.isin("view", "click", "purchase"))
            .select(
                F.col("event_id").alias("interaction_id"),
                F.concat(F.lit("CMP"), F.lpad((F.col("k") % 12).cast("string"), 3, "0")).alias("campaign_id"),
                padded_id("CUST", F.col("user_id")).alias("customer_id"),
                F.when(kind == "view", "impression").when(kind == "click", "click").otherwise("conversion").alias("interaction_type"),
                F.col("ts").alias("interaction_timestamp"),
            )
        )


class Frames(Tables):
    """The nine logical datasets as DataFrames that exist already, such as cleaned and stored ones."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        super().__init__(spark, "")
        self.frames = frames

    def raw(self, name: str) -> DataFrame:
        raise ValueError(f"{name} is no logical dataset")

    def customers(self) -> DataFrame:
        return self.frames["customers"]

    def products(self) -> DataFrame:
        return self.frames["products"]

    def orders(self) -> DataFrame:
        return self.frames["orders"]

    def order_items(self) -> DataFrame:
        return self.frames["order_items"]

    def payments(self) -> DataFrame:
        return self.frames["payments"]

    def website_events(self) -> DataFrame:
        return self.frames["website_events"]

    def customer_support(self) -> DataFrame:
        return self.frames["customer_support"]

    def marketing_campaigns(self) -> DataFrame:
        return self.frames["marketing_campaigns"]

    def campaign_interactions(self) -> DataFrame:
        return self.frames["campaign_interactions"]
