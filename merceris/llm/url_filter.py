"""URL filters: host and path rules first, then a Bloom filter cascade over listed hosts.

The cascade's first level encodes the listed keys. The second encodes those keys of the corpus that the first lets
through by mistake, the third those listed keys that the second lets through, and so on until a level lets none through.
Over the complete key universe of the corpus this is exact. Rows are tested by hashing alone: no row meets the key list.
Only DataFrame functions; no Python in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS_PER_KEY = 10
HASHES = 5
#: Keys of one filter shard, and the largest total of filter bytes that is broadcast; beyond it the shards are joined.
SHARD_KEYS = 200_000
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (verdict, host, path); a rule fits subdomains too."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def _bits(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + k), key), F.lit(size)) for k in range(HASHES)]


def _level(keys: DataFrame, level: int, size: int, shards: int) -> DataFrame:
    """One Bloom filter for each shard: (shard, words), all words dense so that a test is one array access for each bit."""
    bits = keys.select(_shard(F.col("key"), shards).alias("shard"), F.explode(F.array(*_bits(F.col("key"), level, size))).alias("bit"))
    words = bits.groupBy("shard", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set"))
    spark = keys.sparkSession
    blank = spark.range(shards * (size // 64)).select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
    dense = words.unionByName(blank).groupBy("shard", "word").agg(F.expr("bit_or(set)").alias("set"))
    return dense.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))


def _passes(words: Column, key: Column, level: int, size: int) -> Column:
    test = F.lit(True)
    for bit in _bits(key, level, size):
        test = test & (F.getbit(F.element_at(words, F.floor(bit / 64).cast("int") + 1), F.pmod(bit, F.lit(64)).cast("int")) == 1)
    return test


class Cascade:
    """Exact membership of any key of the universe it was built over.

    listed, universe: one column ``key`` each; nulls and repeated keys are ignored, and an empty list matches nothing.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
        keys = universe.select("key").where("key is not null").distinct().join(listed, "key", "left")
        keys = stored(keys.select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
        self.sizes: list[int] = []
        self.filters: DataFrame | None = None
        count = inside.count()
        self.shards = max(1, -(-count // SHARD_KEYS))
        while count:
            size = 64 * -(-BITS_PER_KEY * count // (64 * self.shards))
            level = len(self.sizes)
            words = stored(_level(inside, level, size, self.shards)).withColumnRenamed("words", f"words{level}")
            self.sizes.append(size)
            self.filters = words if self.filters is None else self.filters.join(words, "shard", "left")
            through = self._with_shards(outside, words).where(_passes(F.col(f"words{level}"), F.col("key"), level, size)).select("key")
            inside, outside = stored(through), inside
            count = inside.count()

    def _with_shards(self, rows: DataFrame, filters: DataFrame) -> DataFrame:
        rows = rows.withColumn("shard", _shard(F.col("key"), self.shards))
        small = self.shards * sum(self.sizes) // 8 <= BROADCAST_BYTES
        return rows.join(F.broadcast(filters) if small else filters, "shard", "left")

    def mark(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` (with a column ``key``) and a boolean column ``out``."""
        if self.filters is None:
            return rows.withColumn(out, F.lit(False))
        # passes just the first k levels: listed if k is odd
        member = F.lit(len(self.sizes) % 2 == 1)
        for level in reversed(range(len(self.sizes))):
            member = F.when(_passes(F.col(f"words{level}"), F.col("key"), level, self.sizes[level]), member).otherwise(F.lit(level % 2 == 1))
        return self._with_shards(rows, self.filters).withColumn(out, F.coalesce(member, F.lit(False))).drop("shard", *[f"words{k}" for k in range(len(self.sizes))])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every row: page_id, host, path, rule, listed, verdict.

    listed: DataFrame with a column ``key`` of blocked hosts. The longest fitting rule decides; without one, a listed
    host is blocked and any other allowed. A null url, or one without ``://``, has an empty host and path. Rows and
    repeated ids are kept; other columns are ignored; an empty table gives no rows. A hot host costs nothing extra:
    keys are made distinct with partial aggregation, and rows are never grouped.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("key"), path_of(F.col(url_col)).alias("path"))
    marked = Cascade(listed, rows).mark(rows, "listed")
    rule = rule_of(F.col("key"), F.col("path"), rules)
    marked = marked.withColumn("found", rule)
    return marked.select("page_id", F.col("key").alias("host"), "path", F.col("found.rule").alias("rule"), "listed", F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
