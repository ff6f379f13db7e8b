"""Look-ups of one customer that read a few files.

Profiles, orders, lines, events and tickets are stored once in buckets of customers, sorted by customer, with Parquet Bloom
filters on the customer. A look-up names the bucket (folders are pruned) and the customer (row groups are skipped by
statistics, dictionaries and Bloom filters); it is the function of ``lookup`` or ``measures`` over what is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.plans.gold import Gold
from merceris.sources.adapter import Frames

#: Buckets of customers, and files that each bucket's rows are dealt to: one customer may own very many rows.
BUCKETS, FILES = 64, 2
NAMES = ("profile", "orders", "lines", "events", "tickets")


def bucket_of(customer: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(buckets)).cast("int")


def _table(g: Gold, name: str) -> DataFrame:
    return {"profile": g.profile_view, "orders": lambda: g.orders, "lines": lambda: g.lines, "events": g.tables.website_events, "tickets": g.tables.customer_support}[name]()


def store(g: Gold, root: str, names: Sequence[str] = NAMES, buckets: int = BUCKETS, files: int = FILES) -> None:
    """Write the tables named, one file for each bucket and part of its rows."""
    for name in names:
        df = _table(g, name)
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
        dealt = df.withColumn("bucket", bucket_of(F.col("customer_id"), buckets)).repartition(buckets * files, "bucket", part).sortWithinPartitions("bucket", "customer_id")
        dealt.write.option("parquet.bloom.filter.enabled#customer_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("bucket").parquet(f"{root.rstrip('/')}/{name}")


class Customer(Gold):
    """The stored rows of one customer, as the look-ups take them. A customer that is not stored has none."""

    def __init__(self, spark: SparkSession, root: str, customer_id: str, as_of: str = "2001-09-01", buckets: int = BUCKETS):
        self.root, self.customer_id, self.buckets = root.rstrip("/"), customer_id, buckets
        self.spark = spark
        super().__init__(_Own(self), as_of)

    def rows(self, name: str) -> DataFrame:
        own = F.lit(self.customer_id)
        found = self.spark.read.parquet(f"{self.root}/{name}").where((F.col("bucket") == bucket_of(own, self.buckets)) & (F.col("customer_id") == own))
        return found.drop("bucket")

    @cached_property
    def profile(self) -> DataFrame:
        return self.rows("profile")

    @cached_property
    def orders(self) -> DataFrame:
        return self.rows("orders")

    @cached_property
    def lines(self) -> DataFrame:
        return self.rows("lines")

    def profile_view(self) -> DataFrame:
        return self.rows("profile")


class _Own(Frames):
    """Events and tickets of one customer."""

    def __init__(self, customer: Customer):
        super().__init__(customer.spark, {})
        self.customer = customer

    def website_events(self) -> DataFrame:
        return self.customer.rows("events")

    def customer_support(self) -> DataFrame:
        return self.customer.rows("tickets")
