"""Cutting lineage where both reads of a plan must see the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="merceris-")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of an action as soon as it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders that ``stored`` has written in the innermost ``passing``; None outside of one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def set_for(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; afterwards they are as they were, set or not."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Gives a function that removes the tables which ``stored`` has written inside so far, all but the ``last`` few, for when nothing reads them again."""
    paths: list[str] = []
    outer = _written.set(paths)

    def clear(last: int = 0) -> None:
        while len(paths) > last:
            remove(spark, paths.pop(0))

    try:
        yield clear
    finally:
        _written.reset(outer)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that later reads take only the columns they need.

    The write's shuffle files go when it has ended, as only the table is read again.
    """
    path = scratch(df.sparkSession)
    if (written := _written.get()) is not None:
        written.append(path)
    with set_for(df.sparkSession, {SHUFFLES_GO: "true"}):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
