"""Tables stored by ranges of a column, in which a merge writes only the ranges that a change meets.

Which folder holds which range is itself a small table that is refreshed by version (``versions``), so a merge adds folders,
touches no file that is in use, and readers see all of it or none. One merge runs at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris.operators.clean import deduplicate
from merceris.sources import versions

#: Ranges that a table may have; their least values, and a folder or a few of each, are known to the driver.
MOST_RANGES = 4096
FOLDERS = "part int, folder string"


class RangedTable:
    """A table of unique keys under ``root``, stored by ranges of ``by``, which is the key itself or a column that never changes for a key.

    Rows whose ``by`` is null are in the first range. Rows without a key are kept as they are and never match a change.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, by: str | None = None):
        self.spark, self.root, self.key, self.by = spark, root.rstrip("/"), key, by or key

    def create(self, df: DataFrame, ranges: int) -> None:
        """Store ``df`` as the table's first version, in at most ``ranges`` ranges of about as many rows each."""
        if not 0 < ranges <= MOST_RANGES:
            raise ValueError(f"1 to {MOST_RANGES} ranges")
        dealt = df.repartitionByRange(ranges, self.by).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", self.by, self.key)
        df.limit(0).write.parquet(f"{self.root}/shape")
        folder = self._write(dealt)
        stored = self.spark.read.schema(dealt.schema).parquet(f"{self.root}/data/{folder}")
        stored.groupBy("part").agg(F.min(self.by).alias("least")).write.parquet(f"{self.root}/bounds")
        self._point([(r["part"], folder) for r in stored.select("part").distinct().collect()])  # a row a range

    def _write(self, dealt: DataFrame) -> str:
        folder = uuid.uuid4().hex
        dealt.write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        return folder

    def _point(self, folders: list[tuple[int, str]]) -> None:
        versions.publish(self.spark.createDataFrame(folders, FOLDERS).coalesce(1), f"{self.root}/folders")

    def folders(self, version: int | None = None) -> list[tuple[int, str]]:
        """(range, folder) of a version."""
        return sorted((r["part"], r["folder"]) for r in versions.read(self.spark, f"{self.root}/folders", version).collect())  # a row a range, or a few

    def read(self, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The newest version or an earlier one, whole or some ranges of it."""
        shape = self.spark.read.parquet(f"{self.root}/shape")
        paths = [f"{self.root}/data/{folder}/part={part}" for part, folder in self.folders(version) if parts is None or part in parts]
        return self.spark.read.schema(shape.schema).parquet(*paths) if paths else shape

    def _dealt(self, df: DataFrame) -> DataFrame:
        """``df`` with the range that each row belongs to: the last one whose least value isn't above the row's."""
        bounds = self.spark.read.parquet(f"{self.root}/bounds").agg(F.collect_list(F.struct("part", "least")).alias("__bounds"))  # MOST_RANGES values
        below = F.filter("__bounds", lambda b: b["least"] <= F.col(self.by))
        own = F.array_max(F.transform(below, lambda b: b["part"]))
        return df.crossJoin(F.broadcast(bounds)).withColumn("part", F.coalesce(own, F.lit(0))).drop("__bounds")  # one row

    def _parts(self, dealt: DataFrame) -> set[int]:
        return {r["part"] for r in dealt.select("part").distinct().collect()}  # a row a range

    def merge(self, changes: DataFrame, columns: list[str], insert: bool = True) -> dict[str, set[int]]:
        """Take ``columns`` from ``changes`` where these have a key of the table and a value, and with ``insert`` add their other keys.

        Of several changes of one key the least counts. Only ranges in which a value really differs are written again; new rows
        are a further folder of their range, beside the files that are there. A merge that changes nothing makes no version,
        so repeating one after a failure is safe. Returns the ranges ``rewritten`` and ``added`` to.
        """
        changes = changes.where(F.col(self.key).isNotNull())
        dealt = self._dealt(deduplicate(changes, [self.key]))
        met = self._parts(dealt)
        old = self.read(parts=met)
        new = dealt.select(self.key, "part", *[F.col(c).alias(f"__{c}") for c in columns])
        value = lambda c: F.coalesce(f"__{c}", c)
        differs = F.lit(False)
        for c in columns:
            differs = differs | ~value(c).eqNullSafe(F.col(c))
        # only the key and the columns are read to find the ranges that differ
        rewritten = self._parts(old.select(self.key, *columns).join(new, self.key).where(differs))
        added: set[int] = set()
        folders = self.folders()
        if insert:
            fresh = dealt.join(old.select(self.key), self.key, "left_anti").select(*old.columns, "part")
            added = self._parts(fresh)
        if rewritten:
            rows = self.read(parts=rewritten).join(new.drop("part"), self.key, "left")
            rows = self._dealt(rows.select(*[value(c).alias(c) if c in columns else F.col(c) for c in old.columns]))
            folder = self._write(rows.repartition("part").sortWithinPartitions("part", self.by, self.key))
            folders = [(part, f) for part, f in folders if part not in rewritten] + [(part, folder) for part in rewritten]
        if added:
            folder = self._write(fresh.repartition("part").sortWithinPartitions("part", self.by, self.key))
            folders += [(part, folder) for part in added]
        if rewritten or added:
            self._point(folders)
        return {"rewritten": rewritten, "added": added}
