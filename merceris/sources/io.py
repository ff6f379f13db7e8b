"""Sources and sinks: raw files with explicit schemas, batch folders, and the ways tables are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris import schemas

LAYERS = ("raw", "processed", "curated")


def folder(root: str, layer: str, dataset: str, batch_date: str | None = None) -> str:
    """Where a dataset's files of one layer (and batch) are."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    base = f"{root.rstrip('/')}/{layer}/{dataset}"
    return f"{base}/batch_date={batch_date}" if batch_date else base


def read_raw(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """CSV with a header, or JSON lines, by the dataset's own schema; bad values are null and the row stays.

    A CSV header that differs from the schema is an error when rows are read; otherwise values would stand in the wrong columns.
    """
    reader = spark.read.schema(schemas.schema(dataset)).option("mode", "PERMISSIVE")
    return reader.option("header", True).option("enforceSchema", False).csv(path) if schemas.DATASETS[dataset][2] == "csv" else reader.json(path)


#: The column of lines that are no row of the dataset at all.
BAD_LINE = "_bad_line"
REJECTED = "dataset string, key string, column string, value string, source_file string"


def _as_text(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Raw rows with every column as text, the line itself where it could not be taken apart, and the file."""
    names = schemas.schema(dataset).names
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in [*names, BAD_LINE])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    # without pruning, as a line's fields are counted only where all are read
    df = reader.option("header", True).option("enforceSchema", False).option("columnPruning", False).csv(path) if schemas.DATASETS[dataset][2] == "csv" else reader.json(path)
    return df.select(*names, BAD_LINE, F.col("_metadata.file_path").alias("source_file"))


def read_checked(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the dataset's types, rejected values): what ``read_raw`` turns into null without a trace is kept here as text.

    A value that its column's type can't take is null in its row and a row of the second table, with the row's key, the column and
    the text. A line with too few or too many fields, or no JSON, keeps what could be read of it and is a rejected value of
    column ``_bad_line``. Both are lazy and read the files when they are used.
    """
    text = _as_text(spark, path, dataset)
    typed = [(f.name, f.dataType) for f in schemas.schema(dataset)]
    rows = text.select(*[F.col(c).try_cast(t).alias(c) for c, t in typed])
    entry = lambda c, bad: F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
    bad = [entry(c, F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()) for c, t in typed if t.typeName() != "string"]
    bad.append(entry(BAD_LINE, F.col(BAD_LINE).isNotNull()))
    each = text.select(F.lit(dataset).alias("dataset"), F.col(schemas.key(dataset)).alias("key"), F.explode(F.array_compact(F.array(*bad))).alias("bad"), "source_file")
    return rows, each.select("dataset", "key", "bad.column", "bad.value", "source_file")


def read_batch(spark: SparkSession, root: str, dataset: str, batch_date: str | None, layer: str = "processed") -> DataFrame:
    """One batch, or with None all batches, of a Parquet dataset; the filter prunes folders."""
    df = spark.read.option("basePath", folder(root, layer, dataset)).parquet(folder(root, layer, dataset))
    return df if batch_date is None else df.where(F.col("batch_date") == F.lit(batch_date).cast("date"))


def staged(spark: SparkSession, path: str, dataset: str, batch_date: str) -> DataFrame:
    """Raw rows as they are, with their lineage."""
    return read_raw(spark, path, dataset).select("*", F.lit(batch_date).cast("date").alias("_batch_date"), F.current_timestamp().alias("_loaded_at"), F.col("_metadata.file_path").alias("_source_file"))


def source_status(sources: dict[str, DataFrame]) -> DataFrame:
    """For each required source, whether it holds any row."""
    out = None
    for name, df in sources.items():
        part = df.limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), (F.col("n") > 0).alias("present"))
        out = part if out is None else out.unionByName(part)
    return out


def sources_under(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, status) of the nine raw datasets under ``root``: missing without a folder, empty without a row, else present."""
    out = None
    for name in schemas.DATASETS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(root, "raw", name))
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = read_raw(spark, folder(root, "raw", name), name) if there else spark.range(0)
        state = F.when(F.count("*") > 0, "present").otherwise("empty" if there else "missing")
        part = rows.limit(1).agg(state.alias("status")).select(F.lit(name).alias("dataset"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def raw_sources(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The nine raw datasets under ``root`` and all their rejected values; an error names datasets that are missing or empty."""
    bad = {r["dataset"]: r["status"] for r in sources_under(spark, root).where("status <> 'present'").collect()}  # nine rows at most
    if bad:
        raise ValueError("required sources: " + ", ".join(f"{name} is {status}" for name, status in sorted(bad.items())))
    rows, rejected = {}, None
    for name in schemas.DATASETS:
        rows[name], part = read_checked(spark, folder(root, "raw", name), name)
        rejected = part if rejected is None else rejected.unionByName(part)
    return rows, rejected


def write_processed(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), files: int | None = None) -> None:
    """Overwrite; ``files`` is reached by a shuffle, so the stage before keeps its tasks."""
    df = df.repartition(files) if files else df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_batches(df: DataFrame, path: str, column: str = "batch_date") -> None:
    """Replace just the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def update_from(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with columns taken from ``changes`` where that has the key and a value."""
    other = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(other, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def write_events(df: DataFrame, path: str, moment: str = "event_timestamp") -> None:
    """Events by year, so that a filter on event_year reads only its folders."""
    df.withColumn("event_year", F.year(moment)).write.mode("overwrite").partitionBy("event_year").parquet(path)
