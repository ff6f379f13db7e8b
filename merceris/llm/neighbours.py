"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced partitions by repeated bisection with equal swaps.
A small classifier learns which partition a vector belongs to. Every vector is indexed in its most probable partition;
a query goes to its several most probable ones, whose vectors are then ranked by their exact cosine. How many are
opened is chosen on a second sample, so that enough of its true neighbours' partitions are among them.

Equal vectors are one class that keeps its least ids, so a vector that a third of all rows share costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of the sample that the graph and the classifier see, and of the second one that chooses how many to open.
SAMPLE = 6_000
TRIAL = 400
#: Rows that a partition holds about, and the most and fewest partitions.
PARTITION_ROWS = 800
MOST_PARTITIONS = 128
#: Share of the second sample's neighbours whose partition must be opened.
TARGET = 0.95
GRAPH_DEGREE = 10
#: Rows of an index block and of a query block that one task compares.
BLOCK = 4_096
SALTS = 32
RESULT = "query_id long, rank int, vec_id long, score double"


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; a cosine stays what it is."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k rows of largest product, for each query."""
    out = []
    for at in range(0, len(queries), 500):
        found = queries[at : at + 500] @ rows.T
        out.append(np.argpartition(-found, min(k, found.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(rows: np.ndarray, graph: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """Part of each row, in ``parts`` (a power of two) parts of equal size but for one row, with few graph links cut."""
    part = np.zeros(len(rows), np.int64)
    for _ in range(int(np.log2(parts))):
        fresh = np.empty_like(part)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            # start from the median along the main direction, found by a few power steps
            centred = rows[own] - rows[own].mean(axis=0)
            axis = random.normal(size=rows.shape[1])
            for _ in range(8):
                axis = centred.T @ (centred @ axis)
                axis /= np.linalg.norm(axis) or 1
            side = np.zeros(len(own), bool)
            side[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]] = True
            place = np.full(len(rows), -1)
            place[own] = np.arange(len(own))
            linked = place[graph[own]]
            inside = linked >= 0
            for _ in range(12):
                other = np.where(inside, side[linked] != side[:, None], False).sum(axis=1)
                gain = 2 * other - inside.sum(axis=1)
                a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
                n = min(len(a), len(b))
                if not n:
                    break
                a, b = (x[np.argsort(-gain[x], kind="stable")[: max(1, n // 2)]] for x in (a, b))
                n = min(len(a), len(b))
                side[a[:n]], side[b[:n]] = True, False
            fresh[own] = 2 * p + side
        part = fresh
    return part


@dataclass
class Router:
    """A classifier with one hidden layer; ``open`` is how many partitions a query goes to."""

    first: np.ndarray
    second: np.ndarray
    parts: int
    open: int = 1

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([np.maximum(rows @ self.first, 0), rows]) @ self.second

    def ranked(self, rows: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-self.logits(rows), axis=1, kind="stable")[:, :k]


def train(sample: np.ndarray, trial: np.ndarray, parts: int, k: int, seed: int = 3) -> Router:
    """Partition the sample's neighbour graph, fit the classifier, and choose how many partitions to open."""
    random = np.random.default_rng(seed)
    graph = nearest(sample, sample, min(GRAPH_DEGREE + 1, len(sample)))
    part = balanced_parts(sample, graph, parts, random)
    d, hidden = sample.shape[1], 96
    weights = [random.normal(size=(d, hidden)) * np.sqrt(2 / d) * 2, np.zeros((hidden + d, parts))]
    # a vector's target is spread over the parts of its neighbours
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(sample)), part] += 0.5
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(25):
        order = random.permutation(len(sample))
        for at in range(0, len(order), 256):
            x, y = sample[order[at : at + 256]], target[order[at : at + 256]]
            raw = x @ weights[0]
            full = np.hstack([np.maximum(raw, 0), x])
            z = full @ weights[1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = (z / z.sum(axis=1, keepdims=True) - y) / len(x)
            slopes = [x.T @ ((error @ weights[1][:hidden].T) * (raw > 0)), full.T @ error]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(*weights, parts)
    home = router.ranked(sample, 1)[:, 0]
    ranks = np.empty((len(trial), parts), np.int64)
    np.put_along_axis(ranks, router.ranked(trial, parts), np.arange(parts)[None, :], axis=1)
    wanted = home[nearest(trial, sample, min(k, len(sample)))]
    seen = np.take_along_axis(ranks, wanted, axis=1).ravel()
    router.open = int(np.quantile(seen, TARGET, method="higher")) + 1
    return router


def _usable(vector: Column) -> Column:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    score is the cosine of the original vectors in double precision; ties go to the smaller id; a query is never its own
    neighbour, though an equal vector of another id is. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows without an id. Vectors are compared with those of their own length, one length after the
    other. An id counts once: of its usable vectors the shortest, and of those the one of the least hash. Queries with
    fewer other vectors get fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null")
    rows = rows.where(_usable(F.col("vector")))
    rows = rows.select("id", "vector", F.size("vector").alias("length"), F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")).alias("key"))
    # ids and hashes move here, not vectors
    chosen = stored(rows.groupBy("id").agg(F.min(F.struct("length", "key")).alias("own")).select("id", "own.*"))
    lengths = [r[0] for r in chosen.groupBy("length").count().orderBy("length").collect()]  # a row a length
    parts = [_of_one_length(*(df.where(F.col("length") == n).drop("length") for df in (rows, chosen)), n, every, k) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def _of_one_length(rows: DataFrame, chosen: DataFrame, size: int, every: int, k: int) -> DataFrame:
    """``nearest_neighbours`` of usable rows (id, vector, key) whose vectors have ``size`` components; chosen: (id, key), an id once."""
    spark = rows.sparkSession
    # the least ids of each distinct vector: first within salts of the id, so that no task gets all rows of one vector
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    least = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= k + 1).drop("place")
    few = least(least(chosen.select("key", "id", salt.alias("salt")), "key", "salt").drop("salt"), "key")
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("key").agg(F.first("vector").alias("vector"))
    classes = stored(one.join(ids, "key"))
    count = classes.count()
    if not count:
        return spark.createDataFrame([], RESULT)
    parts = 1 << int(np.clip(np.ceil(np.log2(count / PARTITION_ROWS)), 2, np.log2(MOST_PARTITIONS)))
    share = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, 1.15 * (SAMPLE + TRIAL) / count) * (1 << 30))
    drawn = classes.where(share).select("vector").limit(SAMPLE + TRIAL).toPandas()["vector"]  # the bounded sample
    drawn = unit(np.stack(drawn.to_numpy())) if len(drawn) else np.ones((1, size)) / np.sqrt(size)
    trial = max(1, min(TRIAL, len(drawn) // 5))
    while parts > 1 and len(drawn) - trial < 4 * parts:
        parts //= 2
    router = train(drawn[trial:] if len(drawn) > 1 else drawn, drawn[:trial], parts, k)
    model = spark.sparkContext.broadcast(router)  # its size depends on MOST_PARTITIONS and the vectors' length only

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(part=model.value.ranked(unit(np.stack(batch["vector"].to_numpy())), 1)[:, 0])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=list(model.value.ranked(unit(np.stack(batch["vector"].to_numpy())), model.value.open)))

    key = "key struct<a:long,b:long>"
    indexed = stored(classes.select("key", "vector", "ids").mapInPandas(index, f"{key}, vector array<double>, ids array<long>, part int"))
    asked = chosen.where(F.col("id") % every == 0).select("id", "key")
    queries = stored(classes.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vector").mapInPandas(route, f"{key}, vector array<double>, parts array<int>"))
    routed = queries.select("key", "vector", F.explode("parts").alias("part"))
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = queries.select(F.explode("parts").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    dealt = F.broadcast(sizes.join(asks, "part"))  # MOST_PARTITIONS rows at most
    left = routed.join(dealt, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("key"), "turns").cast("int").alias("turn"), F.col("key").alias("asker"), "vector")
    right = indexed.join(dealt, "part").select("part", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vector", "ids")

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"asker": [], "score": [], "ids": []})
        q, c = (scaled(np.stack(x["vector"].to_numpy())) for x in (asked, held))
        q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        ids, least = held["ids"].to_numpy(), np.array([x[0] for x in held["ids"]])
        out = []
        for at in range(0, len(q), 256):
            near = (q[at : at + 256] / q_norm[at : at + 256, None]) @ (c / c_norm[:, None]).T
            last = np.partition(near, max(near.shape[1] - k - 1, 0), axis=1)[:, max(near.shape[1] - k - 1, 0)]
            for row in range(len(near)):
                # products of whole matrices are rounded in other ways than the measure, so some more are looked at
                some = np.flatnonzero(near[row] >= last[row] - 1e-9)
                score = (c[some] * q[at + row]).sum(axis=1) / (c_norm[some] * q_norm[at + row])
                order = np.lexsort((least[some], -score))[: k + 1]
                out += [(asked["asker"].iloc[at + row], score[i], ids[some[i]]) for i in order]
        return pd.DataFrame(out, columns=["asker", "score", "ids"])

    found = left.groupBy("part", "block", "turn").cogroup(right.groupBy("part", "block", "turn")).applyInPandas(compare, "asker struct<a:long,b:long>, score double, ids array<long>")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    top = found.select("asker", "score", F.explode("ids").alias("id")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = stored(top.groupBy(F.col("asker").alias("key")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near")))
    asked = asked.join(lists, "key").withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k))
    return asked.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
