"""Secret scans: base patterns, and Markov models of random strings against ordinary identifiers.

Only DataFrame functions; no Python in tasks. Two first-order character models are counted from labelled samples; a
long token is a secret if the mean log-likelihood ratio of its character pairs is over a threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: What a text must hold for a kind to be sought in it at all: a cheap test before the pattern.
NEEDS = {"assign": (":", "="), "access": ("AKIA",)}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio (nats for each pair) from which a candidate counts.
THRESHOLD = 0.5
#: About so many documents give labelled samples; one in ORDINARY of them gives ordinary words.
TRAINING_DOCUMENTS = 20_000
ORDINARY = 10
#: Items of an array that a running sum adds up one by one.
BLOCK = 256
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where it stands inside another function's lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each item, ``op`` over ``start`` and all items before it, and at last over all: one item more than ``values``.

    Blocks of BLOCK items are first taken together, so no array grows by one item at a time over its whole length.
    """
    grow = lambda array, first: F.aggregate(array, F.struct(first.alias("at"), F.array(first).alias("out")), lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out")), lambda acc: acc["out"])
    count = lambda v: F.ceil(F.size(v) / BLOCK).cast("int")
    cut = lambda v: F.transform(F.filter(F.sequence(F.lit(0), count(v)), lambda k: k < count(v)), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    # a block's last value is the next one's first
    within = lambda blocks, firsts: F.flatten(F.zip_with(blocks, F.slice(firsts, 1, F.size(blocks)), lambda block, first: F.slice(grow(block, first), 1, F.size(block))))
    sums = lambda blocks: grow(F.transform(blocks, lambda block: F.aggregate(F.slice(block, 2, BLOCK), F.element_at(block, 1), op)), start)
    joined = lambda blocks: _let(sums(blocks), lambda firsts: F.concat(within(blocks, firsts), F.array(F.element_at(firsts, -1))))
    return _let(values, lambda v: _let(cut(v), joined))


def spans_of(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point positions; those whose group is too short are dropped."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    # the text before the k-th match is the k-th piece, so positions are running sums of lengths
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    sizes = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))

    def placed(sizes: Column) -> Column:
        ends = _before(F.transform(sizes, lambda x: x["gap"] + x["hit"]), F.lit(0), lambda a, x: a + x)
        return F.zip_with(F.slice(ends, 2, F.size(sizes)), F.transform(sizes, lambda x: x["hit"]), lambda end, hit: F.struct((end - hit).alias("start"), end.alias("end")))

    span = lambda x, value: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
    found = _let(F.filter(sizes, lambda x: x["hit"].isNotNull()), placed)
    found = F.filter(F.zip_with(found, values, span), lambda x: F.length(x["value"]) >= least)
    return F.when(_may_hold(text, kind) & text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _may_hold(text: Column, kind: str) -> Column:
    out = F.lit(kind not in NEEDS)
    for word in NEEDS.get(kind, ()):
        out = out | F.contains(text, F.lit(word))
    return out


def base_spans(text: Column) -> Column:
    """All spans of the fixed kinds, by start and then by kind as listed."""
    return F.array_sort(F.concat(*_base_kinds(text)))


def _base_kinds(text: Column) -> list[Column]:
    return [spans_of(text, pattern, kind, k, group, least) for k, (kind, pattern, group, least) in enumerate(KINDS)]


def _pairs(value: Column) -> Column:
    """Codes of the neighbouring character pairs of the alphabet."""
    n = len(ALPHABET)
    codes = F.transform(F.split(value, ""), lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c) - 1).otherwise(-1))
    pairs = lambda v: F.zip_with(v, F.slice(v, 2, F.size(v)), lambda a, b: F.when((a >= 0) & (b >= 0), a * n + b))
    return F.filter(_let(codes, pairs), lambda x: x.isNotNull())


def _overlap(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of ``spans``, which rise and don't overlap, has a place in common with start to end (exclusive)."""
    # how many begin before the end: a binary search
    begin = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = (acc["low"] < acc["high"]) & (F.get(spans, middle)["start"] < end)
        return F.struct(F.when(less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    return F.coalesce(F.get(spans, F.aggregate(steps, begin, step, lambda acc: acc["low"]) - 1)["end"] > start, F.lit(False))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio for each pair of characters, from rows (value, secret boolean).

    Add-one smoothing over the alphabet; so without any sample of a class that class is uniform. The table has
    len(ALPHABET) squared entries whatever the input, so it is brought to the driver.
    """
    n = len(ALPHABET)
    counts = samples.where("value is not null and secret is not null").select("secret", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("secret", "pair").count().collect()
    import numpy as np

    table = np.ones((2, n, n))
    for row in counts:
        table[int(row["secret"]), row["pair"] // n, row["pair"] % n] += row["count"]
    shares = np.log(table / table.sum(axis=2, keepdims=True))
    return (shares[1] - shares[0]).ravel().tolist()


def labelled_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(value, secret) from about TRAINING_DOCUMENTS documents, picked by hash: values of base spans, and ordinary words.

    Words come from every ORDINARY-th of those documents that has no base span.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, TRAINING_DOCUMENTS / max(1, docs.count()))
    some = some.where(picked < int(share * (1 << 30)))
    marked = F.col("text").rlike("|".join(f"(?:{p})" for _, p, _, _ in KINDS))
    found = some.where(marked).select(F.explode(base_spans(F.col("text"))).alias("span")).select(F.col("span.value").alias("value"), F.lit(True).alias("secret"))
    words = some.where((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ORDINARY)) == 0) & ~marked)
    plain = words.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_-]{4,}"), F.lit(0))).alias("value"), F.lit(False).alias("secret"))
    return found.unionByName(plain)


def find_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans, *keep): base spans, and those with the model's added as kind ``markov``.

    Spans are structs (start, ord, end, kind, value), sorted; positions are code points, the end exclusive. A candidate
    that overlaps a base span is left out. A null text is empty and has no spans; rows and repeated ids are kept; an
    empty table gives no rows. Texts are taken whole, in time about in proportion to their length and their spans. Narrow:
    no shuffle.
    """
    n = len(ALPHABET)
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') as array<double>)")
    score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1)) / (F.length(v) - 1)
    assert len(model) == n * n
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"), *[F.col(k).alias(k) for k in keep if k != "doc_id"])
    kinds = [f"__kind{k}" for k in range(len(KINDS))]
    # each is used more than once below, so it isn't computed anew inside a lambda
    rows = rows.select("*", *[c.alias(k) for k, c in zip(kinds, _base_kinds(F.col("__text")), strict=True)], spans_of(F.col("__text"), CANDIDATE, "markov", len(KINDS)).alias("__long"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*kinds)))
    hidden = lambda c: reduce(or_, [_overlap(F.col(k), c["start"], c["end"]) for k in kinds])
    fresh = F.when(F.size("__long") == 0, F.col("__long")).otherwise(F.filter("__long", lambda c: (score(c["value"]) >= threshold) & ~hidden(c)))
    return rows.withColumn("spans", F.array_sort(F.concat("base", fresh))).drop("__text", "__long", *kinds)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of find_secrets replaced by ``mark`` (overlapping spans together), and n_chars to match."""
    names = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    found = find_secrets(rows, model, keep=("text", "__row"))
    # four bytes a code point, so that a piece is cut out without a walk from the start
    piece = lambda raw, a, b: F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")

    def masked(raw: Column) -> Column:
        ends = _before(F.col("spans")["end"], F.lit(0), lambda a, x: F.greatest(a, x))
        gaps = lambda ends: F.filter(F.zip_with(F.slice(ends, 1, F.size("spans")), F.col("spans")["start"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] >= x["a"])
        last = lambda ends: F.decode(F.substring(raw, 4 * F.element_at(ends, -1) + 1, F.length(raw)), "UTF-32")
        return _let(ends, lambda ends: F.array_join(F.concat(F.transform(gaps(ends), lambda x: piece(raw, x["a"], x["b"])), F.array(last(ends))), mark))

    masked = _let(F.encode("text", "UTF-32"), masked)
    found = found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    row = F.col("__row")
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*[new.get(c, row[c]).alias(c) for c in names])
