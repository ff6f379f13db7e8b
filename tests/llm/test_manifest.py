"""The Merkle manifest against plain Python: ties, nulls, lone leaves, many groups, clashing names, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from merceris.llm import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASHING = ["key", "target", "path", "group", "kids", "row", "range", "id", "offered", "a.b", "a`b"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node, and each first node's siblings level by level as (left, right)."""
    nodes = list(nodes)
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        place = [p // 8 for p in place]
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    key = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r)))
    trees = [list(g) for _, g in itertools.groupby(sorted(rows, key=key), key=lambda r: r[2])]
    climbed = [climb(map(leaf, t)) for t in trees]
    root, top = climb([c[0] for c in climbed])
    out = []
    for tree, (subroot, paths), above in zip(trees, climbed, top, strict=True):
        for r, own in zip(tree, paths, strict=True):
            path = own + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            value = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for a, b in path:
                value = h(a, value, b)
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in path)), value, value == root))
    return sorted(out, key=str)


def spark_rows(df):
    odd = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = manifest.merkle_manifest(df, COLUMNS, changed=odd, values={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    end = manifest.folded(F.coalesce("offered", "leaf"), F.col("path"))
    return sorted(map(tuple, found.select("id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), end, end == F.col("root")).collect()), key=str)


def some(n, langs, seed):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "É 😀 Text", "Ab" * r.randint(0, 40), "plain", "z" * 200_000 + "Q"])
    return [(r.choice([None, *range(n)]), r.choice([None, "s", "A:1"]), langs(r), r.choice([None, 7]), text()) for _ in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        some(150, lambda r: r.choice([None, "", "de", "é", "en", "en", "en"]), 1),
        some(9, lambda r: "en", 2),
        some(70, lambda r: r.choice(["one", *map(str, range(90))]), 3),  # many lone leaves under a top tree of several levels
        some(1, lambda r: None, 4),
        [(1, "s", "en", 3, "Same")] * 20 + [(1, "s", "en", 3, "other")],
        some(600, lambda r: "en" if r.random() < 0.95 else "fr", 5),
    ],
)
def test_manifest_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert spark_rows(df.select("*", *[F.lit(None).cast("int").alias(c) for c in CLASHING])) == brute(rows)


def test_empty_table(spark):
    empty = manifest.merkle_manifest(spark.createDataFrame([], SCHEMA), COLUMNS)
    assert empty.columns == ["id", "leaf", "offered", "subroot", "root", "path"] and empty.count() == 0
