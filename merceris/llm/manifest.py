"""A Merkle manifest of a table: leaves, a subtree for each group, one root, and every leaf's proof by pointer jumping.

Leaves stand in order by group; every eight consecutive nodes become their parent until one node of the group, its
subroot, is left; the subroots are joined likewise into the root. A level is one aggregation into groups of at most eight.
Each inner node then holds a pointer and the segment of siblings on the way to it: at first its parent and its own
siblings. A self-join looks the pointer up among the nodes, takes over the pointer found there and appends its segment, so
the distance doubles each time and the number of joins is the logarithm of the height. Leaves, seven times as many, take
one jump at the end, over their parent's whole path. A node that many pointers meet is met under many salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, column

#: Nodes that share a parent.
WIDTH = 8
#: A node's key is its level above so many bits, and below them the number of its first leaf (of its first subroot above those).
LEVEL_BITS = 56
#: Levels above the subroots count from here.
TOP = 32
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings as hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: shown(F.concat(s["left"], s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and a path of siblings lead to."""
    return F.reduce(path, leaf, lambda own, s: digest(shown(s["left"]), own, shown(s["right"])))


def _numbered(scope: Scope, df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted by range, stored, with ``range`` (the task) and ``no`` (from 0, over all rows)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scope.stored(sorted_.select(*df.columns, F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")))
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = sizes.select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "range").withColumn("no", F.col("before") + F.col("inside")).drop("before", "inside")


def _raised(nodes: DataFrame, level: int, low: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Parents of nodes (tree, pos, n, key, digest, up, extra): the same columns, with ``kids`` in order and their digests ``row``.

    low: the low bits of a parent's key, from the parent's ``pos`` and ``kids``. A lone node of a tree is its own parent here.
    """
    kid = F.struct("pos", "key", "digest", "up", *extra)
    own = nodes.groupBy("tree", F.call_function("div", F.col("pos"), F.lit(WIDTH)).alias("pos")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.max("n").alias("n"), F.max("up").alias("below"))
    lone, first = F.col("n") == 1, F.col("kids")[0]
    own = own.withColumn("row", F.reduce("kids", F.lit(b""), lambda r, k: F.concat(r, k["digest"])))
    return own.select(
        "tree",
        "pos",
        F.call_function("div", F.col("n") + (WIDTH - 1), F.lit(WIDTH)).alias("n"),
        F.when(lone, first["key"]).otherwise(F.lit((level + 1) << LEVEL_BITS) + low).alias("key"),
        F.when(lone, first["digest"]).otherwise(F.unhex(digest(shown(F.col("row"))))).alias("digest"),
        F.when(lone, F.col("below")).otherwise(F.col("below") + 1).alias("up"),
        lone.alias("lone"),
        "kids",
        "row",
    )


def _siblings(row: Column, place: Column) -> Column:
    """The siblings of the kid at a place (from 0) of its parent's ``row``."""
    return F.struct(F.substring(row, F.lit(1), place * 32).alias("left"), F.substring(row, place * 32 + 33, F.lit(WIDTH * 32)).alias("right"))


def _links(parents: DataFrame, subroots: bool) -> DataFrame:
    """(key, target, path, subroot, up) of all kids of parents."""
    kids = parents.select(F.col("key").alias("target"), "row", F.posexplode("kids").alias("place", "kid"))
    subroot = F.col("kid.digest") if subroots else F.lit(None).cast("binary")
    return kids.select(F.col("kid.key").alias("key"), "target", F.array(_siblings(F.col("row"), F.col("place"))).alias("path"), subroot.alias("subroot"), F.col("kid.up").alias("up"))


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, values: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and whole proof path of every row; the manifest's root is the same on all rows.

    columns: what a leaf holds, in this order. Leaves ascend by id within a group (null first; equal ids by digest), groups
    by their UTF-8 bytes (null first). changed, values: rows that are offered for verification with other values; a row's
    ``offered`` leaf is null where it isn't changed. Returns id, leaf (hex), offered (hex), subroot (hex), root (hex) and
    path (an array of the siblings to the left and right, level by level up to the root), for ``proof_digest`` and ``folded``.

    Nulls in any column enter a leaf as such; a null ``changed`` is false. Empty texts are values of 0 bytes. Repeated rows
    are leaves of their own. An empty table gives no rows. Other columns are ignored, whatever their names. A very long
    text is hashed where it is read and never moves. Texts are read once; from then on a leaf is at most two digests and an id.
    """
    spark = docs.sparkSession
    scope = Scope(spark)
    values = values or {}
    leaf = digest(*[field(column(c)) for c in columns])
    offered = F.when(changed, digest(*[field(values.get(c, column(c))) for c in columns])) if changed is not None else F.lit(None).cast("string")
    group = column(group_col).cast("string")
    leaves = scope.stored(docs.select(column(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("group"), F.unhex(leaf).alias("digest"), F.unhex(offered).alias("offered")))
    placed = _numbered(scope, leaves, [F.col("group"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("offered")])

    # a group of many leaves spans many ranges, so what is known of it is joined by range and group
    spans = placed.groupBy("range", "group").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    groups = scope.stored(_numbered(scope, spans.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n")), [F.col("first")]).select("group", "first", "n", F.col("no").alias("tree")))
    most, trees = groups.agg(F.max("n"), F.count("*")).first()
    if not trees:
        return spark.createDataFrame([], f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, offered string, subroot string, root string, path {PATH}")
    known = placed.select("range", "group").distinct().join(groups, "group")
    nodes = placed.join(known, ["range", "group"]).select("tree", (F.col("no") - F.col("first")).alias("pos"), "n", F.col("no").alias("key"), "digest", F.lit(-1).alias("up"), "id", "offered")

    first_leaf = F.col("kids")[0]["key"].bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    lowest = scope.stored(_raised(nodes, 0, first_leaf, ("id", "offered")))
    inner, level, most = [lowest], 0, -(-most // WIDTH)
    while most > 1:
        level, most = level + 1, -(-most // WIDTH)
        inner.append(scope.stored(_raised(inner[-1].where("n > 1"), level, first_leaf)))
    plain = lambda df: df.where("n = 1").select("tree", "key", "digest", "up")
    top: list[DataFrame] = []
    nodes = reduce(DataFrame.unionByName, map(plain, inner)).select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "key", "digest", "up")
    left, level = trees, 0
    while left > 1:
        top.append(scope.stored(_raised(nodes, TOP + level, F.shiftleft("pos", 3 * (level + 1)))))
        nodes, left, level = top[-1], -(-left // WIDTH), level + 1
    last = nodes.select("key", shown(F.col("digest")).alias("digest")).first()  # one row: the root
    root_key, root = last["key"], last["digest"]

    at_root = spark.range(1).select(F.lit(root_key).alias("key"), F.lit(root_key).alias("target"), F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.lit(0).alias("up"))
    links = [_links(p, False) for p in inner[1:]] + [_links(p, k == 0) for k, p in enumerate(top)]
    pointers = scope.stored(reduce(DataFrame.unionByName, links, at_root))
    reach, height = 1, len(links)
    while reach < height:
        # at this distance a node is the target of up to WIDTH ** reach others
        salts = WIDTH ** (reach // 2)
        ahead = pointers.where(F.col("up") >= reach - 1).select(F.col("key").alias("target"), F.col("target").alias("beyond"), F.col("path").alias("rest"), F.col("subroot").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        there = F.col("target") == root_key
        short = pointers.where(~there).withColumn("salt", F.pmod(F.hash("key"), F.lit(salts))).join(ahead, ["target", "salt"])
        before = pointers
        pointers = scope.stored(short.select("key", F.col("beyond").alias("target"), F.concat("path", "rest").alias("path"), F.coalesce("subroot", "further").alias("subroot"), "up").unionByName(pointers.where(there)))
        scope.drop(before)
        reach *= 2
    scope.keep(lowest, pointers)

    found = lowest.select("key", "lone", "row", "kids").join(pointers.select("key", F.col("path").alias("rest"), "subroot"), "key")
    each = found.select("lone", "row", "rest", "subroot", F.posexplode("kids").alias("place", "kid"))
    path = F.when(F.col("lone"), F.col("rest")).otherwise(F.concat(F.array(_siblings(F.col("row"), F.col("place"))), F.col("rest")))
    return each.select(F.col("kid.id").alias("id"), shown(F.col("kid.digest")).alias("leaf"), shown(F.col("kid.offered")).alias("offered"), F.coalesce(shown(F.col("subroot")), F.lit(root)).alias("subroot"), F.lit(root).alias("root"), path.alias("path"))
