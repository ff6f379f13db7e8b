"""Gold tables kept up to date batch by batch.

A batch is reduced to states that merge: sums, minima and maxima by customer and month, counts by customer and product,
rows of customer and session (which keep distinct sessions exact across batches), and support and campaign sums. States of
a batch are one partition of their table, so loading a batch again replaces it and never counts it twice. Gold tables
are made from the merged states alone; orders, lines and events of earlier batches are not read again. The stored profile
lies in buckets of customers, and a batch rewrites only those buckets that its customers fall into.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.functions.columns import cents, half_up
from merceris.plans.gold import Gold, stats_of_months
from merceris.sources import io
from merceris.sources.adapter import Tables

#: Buckets of customers in the stored tables.
BUCKETS = 32
#: The states' columns as they are stored, before batch and bucket.
COLUMNS = {
    "orders": "customer_id string, month date, total_orders long, completed_orders long, cancelled_orders long, spend long, first_day date, last_day date",
    "products": "customer_id string, category string, product_name string, n long, q long",
    "sessions": "customer_id string, session_id string, n long",
    "tickets": "customer_id string, tickets long, resolved long, hours long, timed long",
    "touches": "customer_id string, n long",
}
#: Their keys; all other columns are sums but these.
KEYS = {"orders": ("customer_id", "month"), "products": ("customer_id", "category", "product_name"), "sessions": ("customer_id", "session_id"), "tickets": ("customer_id",), "touches": ("customer_id",)}
LEAST, MOST = ("first_day",), ("last_day",)


class Batch(Tables):
    """The rows of some tables that a batch brings: orders and events of a stretch of time, and all of the dimensions."""

    def __init__(self, tables: Tables, first: str | None, end: str | None):
        super().__init__(tables.spark, tables.folder)
        self.whole, self.first, self.end = tables, first, end

    def _within(self, df: DataFrame, moment: str) -> DataFrame:
        if self.first is not None:
            df = df.where(F.col(moment) >= F.lit(self.first).cast("timestamp"))
        return df.where(F.col(moment) < F.lit(self.end).cast("timestamp")) if self.end is not None else df

    def customers(self) -> DataFrame:
        return self.whole.customers()

    def products(self) -> DataFrame:
        return self.whole.products()

    def order_items(self) -> DataFrame:
        return self.whole.order_items()

    def orders(self) -> DataFrame:
        return self._within(self.whole.orders(), "order_date")

    def website_events(self) -> DataFrame:
        return self._within(self.whole.website_events(), "event_timestamp")

    def customer_support(self) -> DataFrame:
        return self._within(self.whole.customer_support(), "created_at")

    def campaign_interactions(self) -> DataFrame:
        return self._within(self.whole.campaign_interactions(), "interaction_timestamp")


def bucket_of(customer: Column) -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(BUCKETS)).cast("int").alias("bucket")


def _product_state(lines: DataFrame) -> DataFrame:
    """Counts by customer and product, with their bucket: lines are dealt as they will be stored, so the counts, which are almost as many, need no shuffle."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.hash("customer_id"), F.lit(-(-parts // BUCKETS))).alias("part")
    dealt = lines.select("customer_id", "category", "product_name", "quantity", bucket_of(F.col("customer_id")), part).repartition(parts, "bucket", "part")
    return dealt.groupBy("bucket", "part", *KEYS["products"]).agg(F.count("*").alias("n"), F.sum("quantity").alias("q")).drop("part")


def batch_states(gold: Gold) -> dict[str, DataFrame]:
    """The states of the rows that ``gold`` stands on."""
    hours = cents(F.col("resolution_time"))
    tables = gold.tables
    return {
        "orders": gold.order_months(),
        "products": _product_state(gold.lines),
        "sessions": tables.website_events().groupBy("customer_id", "session_id").agg(F.count("*").alias("n")),
        "tickets": tables.customer_support().groupBy("customer_id").agg(F.count("*").alias("tickets"), F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved"), F.sum(hours).alias("hours"), F.count(hours).alias("timed")),
        "touches": tables.campaign_interactions().groupBy("customer_id").agg(F.count("*").alias("n")),
    }


def merged(name: str, rows: DataFrame) -> DataFrame:
    """One row for each key of a state, from any number of partial ones in any order."""
    rest = [c.split()[0] for c in COLUMNS[name].split(", ") if c.split()[0] not in KEYS[name]]
    return rows.groupBy(*KEYS[name]).agg(*[(F.min if c in LEAST else F.max if c in MOST else F.sum)(c).alias(c) for c in rest])


class KeptStates:
    """The stored states of all batches, under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, batch: str, tables: Tables, names: Collection[str] = tuple(COLUMNS)) -> None:
        """Store the states of one batch, or of them those named; those of an earlier load of the same batch are replaced."""
        for name, state in batch_states(Gold(tables)).items():
            if name not in names:
                continue
            # by bucket, so that a task writes few files
            dealt = state if "bucket" in state.columns else state.withColumn("bucket", bucket_of(F.col("customer_id"))).repartition("bucket")
            path = f"{self.root}/{name}/batch={batch}"
            dealt.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)

    def rows(self, name: str, buckets: list[int] | None = None, batch: str | None = None) -> DataFrame:
        """Partial states; the conditions prune folders."""
        df = self.spark.read.schema(f"{COLUMNS[name]}, batch string, bucket int").parquet(f"{self.root}/{name}")
        df = df if batch is None else df.where(F.col("batch") == batch)
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def state(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return merged(name, self.rows(name, buckets))

    def touched(self, batch: str) -> list[int]:
        """The buckets that a batch has rows of; BUCKETS numbers at most."""
        found = None
        for name in COLUMNS:
            part = self.rows(name, batch=batch).select("bucket")
            found = part if found is None else found.unionByName(part)
        return sorted(r["bucket"] for r in found.distinct().collect())


class KeptGold(Gold):
    """Gold tables from merged states; ``tables`` gives customers and products only. buckets: those of the customers wanted."""

    def __init__(self, states: KeptStates, tables: Tables, as_of: str = "2001-09-01", buckets: list[int] | None = None):
        super().__init__(tables, as_of)
        self.states, self.buckets = states, buckets

    def _state(self, name: str) -> DataFrame:
        return self.states.state(name, self.buckets)

    @cached_property
    def people(self) -> DataFrame:
        every = super().people
        return every if self.buckets is None else every.where(bucket_of(F.col("customer_id")).isin(self.buckets))

    def order_stats(self) -> DataFrame:
        return stats_of_months(self._state("orders"))

    def order_months(self) -> DataFrame:
        return self._state("orders")

    def product_counts(self) -> DataFrame:
        return merged("products", self.states.rows("products", self.buckets).repartition("customer_id"))

    def web_stats(self) -> DataFrame:
        return self._state("sessions").groupBy("customer_id").agg(F.count("session_id").alias("website_sessions"), F.sum("n").alias("website_events"))

    def ticket_stats(self) -> DataFrame:
        return self._state("tickets").select("customer_id", F.col("tickets").alias("support_tickets"), F.col("resolved").alias("resolved_tickets"), half_up(F.col("hours"), F.col("timed") * 100, 2).alias("average_resolution_time"))

    def campaign_stats(self) -> DataFrame:
        return self._state("touches").select("customer_id", F.col("n").alias("campaign_interactions"))

    def customer_months(self) -> DataFrame:
        return self._state("orders").where("completed_orders > 0").select("customer_id", "month")

    def monthly_revenue(self) -> DataFrame:
        return self._state("orders").where("completed_orders > 0").groupBy(F.col("month").alias("metric_month")).agg(F.sum("spend").alias("revenue"))


def refresh_profile(states: KeptStates, tables: Tables, path: str, batch: str, as_of: str = "2001-09-01") -> list[int]:
    """Rewrite the stored profile for the buckets of customers that a batch touches; returns them.

    The first time, and when ``as_of`` moves (ages and days since a purchase count from it), all buckets are to be
    written: delete the stored profile first. Customers without any rows are written then too.
    """
    spark = states.spark
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    buckets = list(range(BUCKETS)) if fresh else states.touched(batch)
    if buckets:
        profile = KeptGold(states, tables, as_of, None if fresh else buckets).base_profile
        dealt = profile.withColumn("bucket", bucket_of(F.col("customer_id"))).repartition("bucket")
        io.replace_batches(dealt, path, "bucket")
    return buckets
