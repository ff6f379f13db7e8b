"""Tables that are refreshed whole and never read half done.

A refresh writes a folder of its own and, only when that is complete, adds one row to the table's list of versions, which
is the pointer that readers follow. Spark's own overwrite would delete the old rows first. A refresh that fails leaves
a folder that nothing points to; ``expire`` removes it with the versions that are no longer kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LIST = "version long, folder string, records long, published_at timestamp"


def _list(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LIST).option("recursiveFileLookup", "true").parquet(f"{root}/versions")


def _folder(spark: SparkSession, path: str):
    """The path in Hadoop's terms, and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder, records, published_at) of all published versions; of two writers of one number the later counts."""
    root = root.rstrip("/")
    path, files = _folder(spark, f"{root}/versions")
    if not files.exists(path):
        return spark.createDataFrame([], LIST)
    last = F.max(F.struct("published_at", "folder", "records")).alias("last")
    return _list(spark, root).groupBy("version").agg(last).select("version", "last.folder", "last.records", "last.published_at")


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the next version of the table at ``root`` and make it the one that is read. Returns its number."""
    spark, root = df.sparkSession, root.rstrip("/")
    folder, counted = f"data/{uuid.uuid4().hex}", Observation()
    df.observe(counted, F.count(F.lit(1)).alias("records")).write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
    newest = versions(spark, root).agg(F.max("version")).first()[0] or 0
    entry = spark.range(1).select(F.lit(newest + 1).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(counted.get["records"]).cast("long").alias("records"), F.current_timestamp().alias("published_at"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/versions")  # one file, visible when it is whole
    return newest + 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or an earlier one by its number."""
    root = root.rstrip("/")
    found = versions(spark, root)
    found = found.where(F.col("version") == version) if version is not None else found
    row = found.orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no version {'' if version is None else version} of {root}")
    return spark.read.parquet(f"{root}/{row['folder']}")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove the data of all but the newest ``keep`` versions, and of refreshes that failed; returns how many folders went.

    Not to be called while a refresh runs, whose folder nothing points to yet, nor while an expired version is read.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    root = root.rstrip("/")
    kept = {r["folder"] for r in versions(spark, root).orderBy(F.desc("version")).limit(keep).collect()}  # ``keep`` rows
    path, files = _folder(spark, f"{root}/data")
    gone = [s.getPath() for s in files.listStatus(path) if f"data/{s.getPath().getName()}" not in kept]
    for one in gone:
        files.delete(one, True)
    return len(gone)
