"""Run and step logs of batches, as small tables, and a recorder that takes a step's figures from its own write."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from merceris.functions.storage import SHUFFLES_GO, set_for

STEPS = "run_id string, step string, started_at timestamp, ended_at timestamp, status string, records long, error string"


def with_duration(steps: DataFrame) -> DataFrame:
    return steps.withColumn("duration_seconds", (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).cast("double"))


def append_steps(steps: DataFrame, path: str) -> None:
    """Add steps to the stored log; rows that it holds already stay as they are."""
    steps.write.mode("append").parquet(path)


def record_step(log: DataFrame, step: DataFrame) -> DataFrame:
    """The log with one more step (a one-row DataFrame of STEPS)."""
    return log.unionByName(step)


def close_runs(steps: DataFrame, quality: DataFrame) -> DataFrame:
    """One row for each run: steps, records, failed steps, failed records and quality status.

    quality: (run_id, status, failed). A run without quality rows passes; quality_checks shows that there were none.
    """
    runs = with_duration(steps).groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("duration_seconds").alias("duration_seconds"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count_if(F.col("status") == "FAILED").alias("failed_steps"))
    checked = quality.groupBy("run_id").agg(F.count("*").alias("quality_checks"), F.sum("failed").alias("failed_records"), F.count_if(F.col("status") == "FAIL").alias("bad"))
    df = runs.join(checked, "run_id", "left").na.fill(0, ["quality_checks", "failed_records", "bad"])
    return df.select("*", F.when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("quality_status"), F.when(F.col("failed_steps") > 0, "FAILED").otherwise("SUCCESS").alias("status")).drop("bad")


def newest(steps: DataFrame, limit: int = 10) -> DataFrame:
    runs = steps.groupBy("run_id").agg(F.max("ended_at").alias("last"))
    return runs.orderBy(F.desc("last"), "run_id").limit(limit)


def steps_of_tables(tables: dict[str, DataFrame], days: str) -> DataFrame:
    """A step log read off dated tables: each day is a run and each table a step with its rows. ``days`` names its date column."""
    out = None
    for name, df in tables.items():
        day = F.to_date(days)
        part = df.groupBy(day.cast("string").alias("run_id")).agg(F.min(days).alias("started_at"), F.max(days).alias("ended_at"), F.count("*").alias("records"))
        part = part.select("run_id", F.lit(name).alias("step"), "started_at", "ended_at", F.when(F.col("records") < 10, "FAILED").otherwise("SUCCESS").alias("status"), "records", F.lit(None).cast("string").alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


#: The recorder's tables. One row for each try of a step, and one for each closing of a run.
TRIES = "run_id string, step string, attempt int, started_at timestamp, ended_at timestamp, status string, records long, null_keys long, error string"
RUNS = "run_id string, started_at timestamp, ended_at timestamp, status string, steps long, failed_steps long, records long, null_keys long, duration_seconds double"
#: Characters of an error that are kept.
ERROR = 2_000


class Recorder:
    """Writes tables for one run and logs each write: when, how many rows, null keys, and the error if it failed.

    Rows and null keys are observed on the write itself, so nothing is read twice. The log is two appended Parquet tables
    under ``root``. An append that was repeated leaves equal (run, step, attempt); reads keep the last of them.
    A write's shuffle files go when it has ended. Without a codec the session's is taken.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, codec: str | None = None):
        self.spark, self.root, self.run_id, self.codec = spark, root.rstrip("/"), run_id, codec
        self.tries: dict[str, int] = {}

    def _append(self, table: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def build(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, which may write tables that the step needs; if it fails, that is a failed try of the step."""
        began = datetime.now(UTC)
        try:
            return make()
        except Exception as failed:
            self.tries[step] = attempt = self.tries.get(step, 0) + 1
            self._append("steps", (self.run_id, step, attempt, began, max(began, datetime.now(UTC)), "FAILED", None, None, str(failed)[:ERROR]), TRIES)
            raise

    def write(self, step: str, df: DataFrame, key: str, path: str) -> DataFrame:
        """``df`` written to ``path`` and read back; a failure is logged and raised again."""
        self.tries[step] = attempt = self.tries.get(step, 0) + 1
        began, seen, error = datetime.now(UTC), Observation(), None
        observed = df.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col(key).isNull()).alias("null_keys"))
        try:
            with set_for(self.spark, {SHUFFLES_GO: "true"}):
                observed.write.mode("overwrite").parquet(path, compression=self.codec)
        except Exception as failed:
            error = str(failed)[:ERROR]
            raise
        finally:
            figures = {} if error is not None else seen.get
            ended = max(began, datetime.now(UTC))
            self._append("steps", (self.run_id, step, attempt, began, ended, "SUCCESS" if error is None else "FAILED", figures.get("records"), figures.get("null_keys"), error), TRIES)
        return self.spark.read.parquet(path)

    def store(self, folder: str):
        """A ``store`` for ``warehouse.load``: each table in a folder of its own name."""
        return lambda name, df, key: self.write(name, df, key, f"{folder.rstrip('/')}/{name}")

    def close(self) -> None:
        """Add the run's row: failed if the last try of any step failed. Figures are those of the last tries, times those of all."""
        own = read_tries(self.spark, self.root).where(F.col("run_id") == self.run_id)
        last = own.groupBy("run_id", "step").agg(F.max_by(F.struct("status", "records", "null_keys"), "attempt").alias("last"), F.min("started_at").alias("a"), F.max("ended_at").alias("z"))
        seconds = (F.unix_micros(F.max("z")) - F.unix_micros(F.min("a"))) / 1_000_000
        bad = F.count_if(F.col("last.status") == "FAILED")
        total = lambda c: F.coalesce(F.sum(f"last.{c}"), F.lit(0))
        run = last.groupBy("run_id").agg(F.min("a"), F.max("z"), F.when(bad > 0, "FAILED").otherwise("SUCCESS"), F.count("*"), bad, total("records"), total("null_keys"), seconds)
        run.toDF(*[c.split()[0] for c in RUNS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")


def read_tries(spark: SparkSession, root: str) -> DataFrame:
    """The step log; of repeated rows of a run's step and attempt the one that ended last."""
    rows = spark.read.schema(TRIES).parquet(f"{root.rstrip('/')}/steps")
    rest = [c.split()[0] for c in TRIES.split(", ")][3:]
    last = rows.groupBy("run_id", "step", "attempt").agg(F.max(F.struct("ended_at", *[c for c in rest if c != "ended_at"])).alias("last"))
    return last.select("run_id", "step", "attempt", *[F.col(f"last.{c}").alias(c) for c in rest])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run log; of a run that was closed more than once, the row of the last closing."""
    rows = spark.read.schema(RUNS).parquet(f"{root.rstrip('/')}/runs")
    names = [c.split()[0] for c in RUNS.split(", ")][1:]
    last = rows.groupBy("run_id").agg(F.max(F.struct("ended_at", "steps", *[c for c in names if c not in ("ended_at", "steps")])).alias("last"))
    return last.select("run_id", *[F.col(f"last.{c}").alias(c) for c in names])
