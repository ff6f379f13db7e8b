"""Global order without a one-partition window, and NTILE without global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merceris.functions.storage import stored


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with dense row numbers from 1 in the given order, which should end in a unique column.

    Rows are sorted by range over all tasks and numbered inside them by their place in the task, which is the one shuffle;
    the counts of the ranges before are one small row for each task. Ranges and places are stored first, so counting
    and numbering see the same split.
    """
    # an id is the task's number above 33 bits and the row's place in the task below them
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = stored(placed.withColumn("__range", F.shiftright("__id", 33)))
    numbered = ranged.withColumn("__inside", F.col("__id") % (1 << 33) + 1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = numbered.join(F.broadcast(before), "__range")  # one row a task
    return joined.withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__id", "__range", "__inside", "__before")


def ntile_of(row_number: Column, rows: Column, buckets: int) -> Column:
    """The bucket that NTILE gives the row: the first ``rows % buckets`` buckets have one row more."""
    small = F.call_function("div", rows, F.lit(buckets))
    large = rows % buckets
    edge = large * (small + 1)
    first = F.call_function("div", row_number - 1, small + 1) + 1
    rest = large + F.call_function("div", row_number - edge - 1, F.greatest(small, F.lit(1))) + 1
    return F.when(row_number <= edge, first).otherwise(rest).cast("int")


#: Cells of equal width among which the keys of tied rows are counted.
KEY_CELLS = 1 << 16
#: Leading bits of a value that its cell keeps.
CELL_BITS = 12


def _cell(value: Column) -> Column:
    """A cell that grows with the value: exact to 2 ** CELL_BITS, then CELL_BITS bits after the leading one, so there are
    64 * 2 ** CELL_BITS cells of either sign at most, whatever the values."""

    def above(v: Column) -> Column:
        spare = F.greatest(F.length(F.bin(v)) - 1 - CELL_BITS, F.lit(0))
        return spare.cast("long") * (1 << CELL_BITS) + F.call_function("shiftright", v, spare)

    return F.when(value >= 0, above(value)).otherwise(-above(F.bitwise_not(value)) - 1)


def _holding(counts: DataFrame, cells: list[str]) -> DataFrame:
    """Of (name, b, cells, size, need) the cell of each name and border that holds the row number ``need``, which becomes the number in it."""
    upto = F.sum("size").over(Window.partitionBy("name", "b").orderBy(*cells).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("size") < F.col("need")))
    return found.select("name", "b", *cells, (F.col("need") - F.col("upto") + F.col("size")).alias("need"))


def ntiles(df: DataFrame, key: str, values: dict[str, Column], buckets: int) -> DataFrame:
    """``df`` with NTILE(buckets) over each of ``values`` (whole numbers, ascending; ties by ``key``, a unique string), under their names.

    No row is sorted: only the last row of each bucket is looked for. Values are counted by coarse cells; in the cells that
    hold those rows by value and by cells of the key's leading bytes, of which there are KEY_CELLS; and the rows of the one cell
    that is left are ranked. Then every row is compared with ``buckets - 1`` rows for each value. All of it is one lazy plan of
    three passes over ``df`` that end in partial counts, and a last one. Windows see 2 ** 19 coarse cells at most, the finer
    cells of one coarse cell, and the keys of one of these.
    """
    pairs = [F.struct(F.lit(name).alias("name"), v.cast("long").alias("value")) for name, v in values.items()]
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*pairs)).alias("v")).select("key", "v.name", "v.value")
    cells = long.groupBy("name", _cell(F.col("value")).alias("cell")).agg(F.count("*").alias("size"), F.min("key").alias("a"), F.max("key").alias("z"))

    # keys as numbers: the bytes after those that the least and the greatest key share
    ends = cells.agg(F.hex(F.min("a")).alias("a"), F.hex(F.max("z")).alias("z"))
    same = F.reduce(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring("a", F.lit(1), k) == F.substring("z", F.lit(1), k)), k).otherwise(n))
    number = lambda c: F.conv(F.rpad(F.substring(c, F.col("skip") + 1, F.lit(14)), 14, "0"), 16, 10).cast("long")
    ends = ends.select("*", same.alias("skip")).select("skip", number(F.col("a")).alias("least"), F.call_function("div", number(F.col("z")) - number(F.col("a")), F.lit(KEY_CELLS)).alias("width"))

    rows = F.sum("size").over(Window.partitionBy("name"))
    last = F.col("b") * F.call_function("div", F.col("rows"), F.lit(buckets)) + F.least(F.col("b"), F.col("rows") % buckets)
    wanted = cells.select("name", "cell", "size").withColumn("rows", rows).select("*", F.explode(F.sequence(F.lit(1), F.lit(max(buckets - 1, 1)))).alias("b")).withColumn("need", last)
    at = _holding(wanted, ["cell"])  # a row for each value and border, as below
    part = F.call_function("div", number(F.hex("key")) - F.col("least"), F.col("width") + 1)
    near = long.withColumn("cell", _cell(F.col("value"))).join(F.broadcast(at), ["name", "cell"]).join(F.broadcast(ends)).withColumn("part", part)
    at = _holding(near.groupBy("name", "b", "need", "value", "part").agg(F.count("*").alias("size")), ["value", "part"])
    rest = long.join(F.broadcast(ends)).withColumn("part", part).join(F.broadcast(at), ["name", "value", "part"])
    border = rest.withColumn("turn", F.row_number().over(Window.partitionBy("name", "b").orderBy("key"))).where("turn = need")
    borders = border.agg(*[F.collect_list(F.when(F.col("name") == name, F.struct("value", "key"))).alias(f"__{name}") for name in values])
    beyond = lambda name, v: F.size(F.filter(f"__{name}", lambda x: (v > x["value"]) | ((v == x["value"]) & (F.col(key) > x["key"]))))
    if buckets == 1:
        return df.select("*", *[F.lit(1).alias(name) for name in values])
    return df.join(F.broadcast(borders)).select(*df.columns, *[(beyond(name, v.cast("long")) + 1).alias(name) for name, v in values.items()])


def dense_key(df: DataFrame, natural: str, name: str) -> DataFrame:
    """A whole-number key from 1 for each row, in order of the natural key."""
    return global_row_number(df, [F.col(natural)], name)
