"""Event transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_summary(events: DataFrame) -> DataFrame:
    """One row for each session and set of attributes seen in it, with numbers of the whole session.

    Events without a session are one session. As that one can be large, its numbers are one row that all its rows get.
    """
    attributes = ["session_id", "customer_id", "device", "traffic_source"]
    numbers = {"event_count": F.sum, "session_start": F.min, "session_end": F.max, "converted": F.max}
    parts = events.groupBy(*attributes).agg(
        F.count("*").alias("event_count"),
        F.min("event_timestamp").alias("session_start"),
        F.max("event_timestamp").alias("session_end"),
        F.coalesce(F.max((F.col("event_type") == "purchase").cast("int")), F.lit(0)).alias("converted"),
    )
    one = Window.partitionBy("session_id")
    named = parts.where(F.col("session_id").isNotNull()).select(*attributes, *[f(c).over(one).alias(c) for c, f in numbers.items()])
    others = parts.where(F.col("session_id").isNull())
    whole = others.agg(*[f(c).alias(c) for c, f in numbers.items()])
    others = others.select(*attributes).crossJoin(F.broadcast(whole))  # one row
    return named.unionByName(others).withColumn("duration_seconds", F.unix_timestamp("session_end") - F.unix_timestamp("session_start"))


def top_viewed(events: DataFrame, top: int = 5) -> DataFrame:
    """The most viewed products of each day by rank; ties can make more than ``top`` rows."""
    views = events.where((F.col("event_type") == "product_view") & F.col("product_id").isNotNull())
    daily = views.groupBy(F.to_date("event_timestamp").alias("event_date"), "product_id").agg(F.count("*").alias("view_count"))
    return daily.withColumn("rank", F.rank().over(Window.partitionBy("event_date").orderBy(F.desc("view_count")))).where(F.col("rank") <= top)
