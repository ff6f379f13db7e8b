"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy code in pieces of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, one under the temporary folder in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="merceris-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/merceris-{uuid.uuid4().hex}"


#: Folders of the tables that are in use, in the order in which they were written.
_written: list[str] = []
#: Whether Spark removes the shuffle files of an action as soon as it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost executor costs nothing.

    The write's shuffle files go when it has ended, as only the table is read again.
    """
    path, out = _write(df, partition_by)
    _written.append(path)
    return out


def _write(df: DataFrame, partition_by: list[str] | None = None, compression: str | None = None) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path, partitionBy=partition_by, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    return path, out.select(*map(column, df.columns)) if partition_by else out


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


class Scope:
    """The tables that one call of an operator writes, so that calls side by side never touch each other's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
        """``stored``, and remembered here."""
        path, out = _write(df, partition_by, compression)
        self.paths[id(out)] = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this scope that nothing reads again."""
        for t in tables:
            _remove(self.spark, self.paths.pop(id(t)))

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Remove one partition (``column=value``) of a table that nothing reads again."""
        _remove(self.spark, f"{self.paths[id(table)]}/{part}")

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        self.drop(*(t for t in self.tables if id(t) in self.paths and all(t is not k for k in tables)))


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, stored; those stored on the way to it are removed, as nothing reads them again."""
    first = len(_written)
    out = stored(make())
    for path in _written[first:-1]:
        _remove(out.sparkSession, path)
    del _written[first:-1]
    return out


def column(name: str) -> Column:
    """A column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns and their names never matter."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of whole texts of about ``limit`` characters."""
    first, size = 0, 0
    for row, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, row + 1
            first, size = row + 1, 0
    if first < len(texts):
        yield first, len(texts)


def byte_slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes.

    Gives (first row, end row, the texts' UTF-8 bytes joined, their start offsets with the end). A null text is empty.
    """
    first, size, parts = 0, 0, []
    for row, text in enumerate(texts):
        part = (text or "").encode("utf-8", "surrogatepass")
        parts.append(part)
        size += len(part)
        if size >= limit:
            yield first, row + 1, b"".join(parts), _offsets(parts)
            first, size, parts = row + 1, 0, []
    if parts:
        yield first, len(texts), b"".join(parts), _offsets(parts)


def _offsets(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return out


def spelt_out(pattern: str, characters: str) -> str:
    """A pattern of the library regex for the faster re, which knows no categories: their members among ``characters``.

    Both find the same in texts of these characters only.
    """
    import re

    import regex

    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part.startswith(r"\p{"):
            own = re.escape("".join(regex.findall(part, characters)))
            part = own if inside else f"[{own}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


#: Bits of a set of keys that lets most other rows be dropped before a shuffle, and of one row of it. Its size is fixed.
SET_BITS = 1 << 25
SET_ROW = 1 << 16


def key_set(keys: DataFrame, name: str) -> np.ndarray:
    """A long column's values as SET_BITS bits by their low bits, packed; a value that is in the column is in the set."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SET_ROW, bool)
        bits[group["bit"].to_numpy()] = True
        return pd.DataFrame({"row": [group["row"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    place = F.col(name).bitwiseAND(F.lit(SET_BITS - 1))
    cells = keys.select((place / SET_ROW).cast("int").alias("row"), (place % SET_ROW).cast("int").alias("bit")).distinct()
    out = np.zeros((SET_BITS // SET_ROW, SET_ROW // 8), np.uint8)
    for r in cells.groupBy("row").applyInPandas(add, "row int, bits binary").collect():  # SET_BITS bits, whatever the input
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_key_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (SET_BITS - 1)
    return bits[place >> 3] >> (7 - (place & 7)) & 1 == 1
