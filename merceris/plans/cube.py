"""Exact distinct counts of sessions that roll up: bitmaps by day, device, traffic source and event type, merged for any slice.

Distinct counts of parts can't be added, since a session may be in several of them. Sessions are therefore numbered densely
once, and each cell of the cube holds a bitmap of its sessions, cut into blocks of 32,768 numbers. A slice is the union of its cells'
bitmaps; its count is their bits. Numbers follow the day, so the sessions of a cell lie in few blocks.

Batches are added one by one: sessions met before keep their numbers, others get the next ones. A batch loaded again
replaces its own cells. One batch is added at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.functions.columns import half_up, percent
from merceris.operators.ranking import global_row_number

#: What a cell of the cube is named by.
BY = ("day", "device", "traffic_source", "event_type")
NUMBERS = "session_id string, number long"
CELLS = "day date, device string, traffic_source string, event_type string, block long, sessions binary, events long, batch string"
#: Funnel steps and the event types that show them (fixed values).
STEPS = {"seen": "page_view", "viewed_product": "product_view", "added_to_cart": "add_to_cart", "started_checkout": "checkout_start", "purchased": "purchase"}


class SessionCube:
    """The stored cube and its session numbers, under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def numbers(self) -> DataFrame:
        """(session_id, number) of all sessions met so far; numbers begin at 1 and have no gaps."""
        return self.spark.read.schema(NUMBERS).parquet(f"{self.root}/numbers") if self._there("numbers") else self.spark.createDataFrame([], NUMBERS)

    def add(self, batch: str, events: DataFrame) -> None:
        """Store the cells of one batch of events; those of an earlier load of the same batch are replaced.

        Events without a session are counted as events and as no session. Where a batch fails after its sessions are
        numbered, the numbers stay and the next load of the batch finds them.
        """
        events = events.withColumn("day", F.to_date("event_timestamp"))
        met = events.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("day").alias("first_day"))
        new = met.join(self.numbers(), "session_id", "left_anti")
        last = self.numbers().agg(F.max("number")).first()[0] or 0
        numbered = global_row_number(new, [F.col("first_day"), F.col("session_id")], "number")
        numbered.select("session_id", (F.col("number") + last).alias("number")).write.mode("append").parquet(f"{self.root}/numbers")
        # rows of one cell and session meet first, so an event's row never waits for its number
        parts = events.groupBy(*BY, "session_id").agg(F.count("*").alias("events"))
        known = parts.where(F.col("session_id").isNotNull()).join(self.numbers(), "session_id").drop("session_id")
        unknown = parts.where(F.col("session_id").isNull()).select(*BY, "events", F.lit(None).cast("long").alias("number"))
        cells = known.unionByName(unknown).groupBy(*BY, F.bitmap_bucket_number("number").alias("block"))
        cells = cells.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("sessions"), F.sum("events").alias("events"))
        cells.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.root}/cells/batch={batch}")

    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.root}/cells")

    def counts(self, by: Sequence[Column] = (), measures: dict[str, Column | None] | None = None, where: Column | None = None) -> DataFrame:
        """Distinct sessions and all events by any columns of the cube, over any slice of it.

        measures: names of distinct counts with the cells they are over (None: all). ``events`` is the count of events.
        Partial unions are 4 kB a group and block, whatever the number of events.
        """
        cells = self.cells() if where is None else self.cells().where(where)
        names = [f"__by{k}" for k in range(len(by))]
        cells = cells.select("*", *[c.alias(n) for n, c in zip(names, by)])
        measures = measures or {"sessions": None}
        own = [F.bitmap_or_agg(F.col("sessions") if m is None else F.when(m, F.col("sessions"))).alias(f"__bits_{n}") for n, m in measures.items()]
        blocks = cells.groupBy(*names, "block").agg(*own, F.sum("events").alias("events"))
        return blocks.groupBy(*names).agg(*[F.coalesce(F.sum(F.bitmap_count(f"__bits_{n}")), F.lit(0)).alias(n) for n in measures], F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def _named(column: str) -> Column:
    return F.coalesce(column, F.lit("Unknown"))


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def sessions(cube: SessionCube) -> DataFrame:
    return cube.counts().select("sessions")


def conversion_rate(cube: SessionCube) -> DataFrame:
    return cube.counts(measures={"sessions": None, "bought": _is("purchase")}).select(half_up(F.col("bought"), F.col("sessions"), 4).alias("conversion_rate"))


def devices(cube: SessionCube) -> DataFrame:
    found = cube.counts([_named("device")], {"sessions": None, "converting_sessions": _is("purchase")})
    return found.select(F.col("__by0").alias("device_name"), "sessions", F.col("events").alias("total_events"), "converting_sessions", percent(F.col("converting_sessions"), F.col("sessions")).alias("conversion_rate_pct"))


def sessions_by_source(cube: SessionCube) -> DataFrame:
    return cube.counts([_named("traffic_source")]).select(F.col("__by0").alias("traffic_source"), "sessions")


def five_steps(cube: SessionCube) -> DataFrame:
    return cube.counts(measures={n: _is(t) for n, t in STEPS.items()}).drop("events").unpivot([], list(STEPS), "step", "sessions")


def funnel(cube: SessionCube) -> DataFrame:
    """Sessions that reached each step; unlike ``reports.funnel``, events without a session are no session."""
    steps = {n: _is(t) for n, t in STEPS.items() if n != "seen"}
    found = cube.counts(measures={"total_sessions": None, **steps}).drop("events")
    share = lambda a, b, name: percent(F.col(a), F.col(b)).alias(name)
    return found.select("*", share("added_to_cart", "viewed_product", "view_to_cart_pct"), share("purchased", "started_checkout", "checkout_to_purchase_pct"), share("purchased", "total_sessions", "overall_conversion_pct"))


def source_by_month(cube: SessionCube) -> DataFrame:
    """A roll-up of two columns: sessions of each month and source, of each month, of each source, and of all."""
    month, source = F.trunc("day", "month").cast("string"), _named("traffic_source")
    out = None
    for by in ((month, source), (month, None), (None, source), (None, None)):
        found = cube.counts([c for c in by if c is not None], {"sessions": None, "bought": _is("purchase")})
        place = iter(range(2))
        names = [F.lit(None).cast("string").alias(n) if c is None else F.col(f"__by{next(place)}").alias(n) for n, c in zip(("month", "traffic_source"), by)]
        part = found.select(*names, "sessions", "bought", "events")
        out = part if out is None else out.unionByName(part)
    return out
