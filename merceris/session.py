"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "merceris", master: str | None = None, **conf: str) -> SparkSession:
    """UTC time, adaptive execution, dynamic partition overwrite; anything in ``conf`` wins (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.parquet.compression.codec": "snappy"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
