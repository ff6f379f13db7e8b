"""Repeated byte strings across a corpus, by suffix order of content-defined shards.

Every window of ``span`` bytes picks an anchor, its substring of least hash; equal windows pick the same anchor at the
same place. Neighbouring windows with one anchor make a run. Runs whose anchor occurs once hold nothing repeated; runs
that a text has twice, as words or lines said over and over, and runs that are equal wherever their anchor occurs are
repeated as a whole; these are settled by counts, and equal runs of a text are one row with all their starts. The other
runs, one of each distinct content, go to shards by anchor, so equal windows always meet. A shard is sorted by external
induced sorting, whose queues spill to disk, and a window is repeated if its suffix shares ``span`` bytes with a
neighbour in suffix order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import column, finished, in_key_set, key_set, stored
from .suffixes import neighbours

#: Window starts that are hashed together; longer texts are cut there, which only makes their border runs distinct.
CHUNK = 1 << 20
#: Bytes of one shard; and distinct runs of one anchor that a shard may hold: up to about 4 MB of text, 200 MB to sort. The runs of an
#: anchor with more are cut into shorter ones by anchors of so many parts of a hundred of the window, the last the whole.
SHARD_BYTES = 500_000
MANY_RUNS = 12_000
ANCHORS = (36, 75, 100)

_random = np.random.default_rng(23)
_BYTES = _random.integers(0, 2**64, 256, np.uint64)
_BASE = int(_random.integers(0, 2**62)) * 2 + 1
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that make hashes independent of their place."""
    n = len(data) + 1
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    out = np.zeros(n, np.uint64)
    np.cumsum(_BYTES[data] * _powers[0][: n - 1], out=out[1:])
    return out, _powers[1]


def runs(raw: bytes, span: int, share: int = ANCHORS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, mark, start, windows) of each run of windows with one anchor; mark is a digest of the run's bytes.

    An anchor is a substring of ``share`` hundredths of ``span``. Different ones of equal hash do no harm, they only meet.
    """
    gram = max(4, span * share // 100)
    width = span - gram + 1
    data, parts = np.frombuffer(raw, np.uint8), []
    for chunk in range(0, len(data) - span + 1, CHUNK):
        own = data[chunk : chunk + CHUNK + span - 1]
        sums, factors = _sums(own)
        grams = _mix((sums[gram:] - sums[:-gram]) * factors[: len(own) - gram + 1])
        # the place in the low bits makes the leftmost of equal grams the least
        least, step = grams >> np.uint64(21) << np.uint64(21) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        starts = np.flatnonzero(np.diff(least, prepend=least[:1] ^ np.uint64(1)))
        ends = np.append(starts[1:], len(least))
        digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((starts + chunk).tolist(), (ends + (chunk + span - 1)).tolist(), strict=True)]
        parts.append((_mix(least[starts] >> np.uint64(21)).view(np.int64), np.frombuffer(b"".join(digests), np.int64), starts + chunk, ends - starts))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def distinct_runs(text: np.ndarray, anchor: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of each text's equal runs, and the starts of all of them in order; ``text`` is the text's number."""
    if not len(text):
        return np.zeros(0, np.int64), []
    order = np.lexsort((start, mark, anchor, text))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in (text, anchor, mark)], axis=0)
    first = np.flatnonzero(new)
    return order[first], np.split(start[order], first[1:])


def repeated_in_shard(contents: list[bytes], windows: list[int], copies: list[int], span: int) -> list[np.ndarray]:
    """For each run, which of its windows are repeated, in the shard or by the run's copies."""
    symbols = np.concatenate([x for raw in contents for x in (np.frombuffer(raw, np.uint8).astype(np.uint16) + np.uint16(2), np.ones(1, np.uint16))] + [np.zeros(1, np.uint16)])
    common = neighbours(symbols, span)
    out, at = [], 0
    for raw, n, c in zip(contents, windows, copies, strict=True):
        out.append(common[at : at + n] >= span if c < 2 else np.ones(n, bool))
        at += len(raw) + 1
    return out


def spans_of(starts: np.ndarray, size: int, span: int) -> np.ndarray:
    """Maximal covered runs (start, end) of windows that begin at ``starts`` (any order)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = np.unique(starts)
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > starts[:-1] + span
    last = np.append(first[1:], True)
    return np.stack([starts[first], starts[last] + span], axis=1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def _verdicts(contents: DataFrame, span: int, anchors: tuple[int, ...], many_runs: int) -> DataFrame:
    """(anchor, mark, bits) of the runs with repeated windows; null bits mean all.

    contents: distinct runs (anchor, mark, copies, windows, content). Runs of one anchor go to one shard, which is put into
    suffix order. Where they are too many for a shard, they are cut by longer anchors; equal windows have these in common
    too. With an anchor as long as the window every run is one window, and its copies alone decide.
    """
    kinds = stored(contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.length("content") + 1).alias("size")))
    most = many_runs if anchors else 1 << 62
    total = kinds.where((F.col("kinds") > 1) & (F.col("kinds") <= most)).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        found = repeated_in_shard(group["content"].tolist(), group["windows"].tolist(), group["copies"].tolist(), span)
        out = group[["anchor", "mark"]].assign(bits=[np.packbits(x).tobytes() for x in found])
        return out[[bool(x.any()) for x in found]]

    schema = "anchor long, mark long, bits binary"
    known = contents.join(kinds.select("anchor", "kinds"), "anchor")
    alone = known.where((F.col("kinds") == 1) & (F.col("copies") > 1)).select("anchor", "mark", F.lit(None).cast("binary").alias("bits"))
    shared = known.where((F.col("kinds") > 1) & (F.col("kinds") <= most)).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *contents.columns)
    out = alone.unionByName(shared.groupBy("shard").applyInPandas(shard, schema))
    if not anchors or kinds.where(F.col("kinds") > most).isEmpty():
        return out

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                anchor, mark, start, windows = runs(row.content, span, anchors[0])
                parts = [row.content[a : a + n + span - 1] for a, n in zip(start.tolist(), windows.tolist(), strict=True)]
                yield pd.DataFrame({"of": row.anchor, "of_mark": row.mark, "at": start, "anchor": anchor, "mark": mark, "copies": row.copies, "windows": windows, "content": parts})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(int((group["at"] + group["windows"]).max()), bool)
        for at, n, own in zip(group["at"], group["windows"], group["bits"], strict=True):
            told = np.ones(n, np.uint8) if own is None else np.unpackbits(np.frombuffer(own, np.uint8))[:n]
            bits[at : at + len(told)] = told  # what is missing at the end is 0
        return pd.DataFrame({"anchor": [group["of"].iloc[0]], "mark": [group["of_mark"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    crowded = known.where(F.col("kinds") > most).drop("kinds")
    parts = stored(crowded.mapInPandas(split, "of long, of_mark long, at int, anchor long, mark long, copies int, windows int, content binary"))
    finer = parts.groupBy("anchor", "mark").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("windows").alias("windows"), F.first("content").alias("content"))
    below = stored(_verdicts(stored(finer), span, anchors[1:], many_runs))
    found = parts.select("of", "of_mark", "at", "windows", "anchor", "mark").join(below, ["anchor", "mark"])
    return out.unionByName(found.groupBy("of", "of_mark").applyInPandas(gather, schema))


def repeated_windows(keyed: DataFrame, span: int, many_runs: int = MANY_RUNS) -> DataFrame:
    """(key, cover): for each distinct text with repeated windows, structs (starts, windows, bits) of its distinct runs; null bits mean all."""
    spark = keyed.sparkSession

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [runs(t.encode("utf-8", "surrogatepass"), span) for t in part["text"]]
                out = pd.DataFrame({"key": part["key"], **{c: [f[k] for f in found] for k, c in enumerate(("anchor", "mark", "start", "windows"))}})
                yield out[[len(f[0]) > 0 for f in found]]

    described = stored(keyed.select("key", "text").mapInPandas(describe, "key binary, anchor array<long>, mark array<long>, start array<long>, windows array<int>"))
    pairs = described.select(F.explode(F.arrays_zip("anchor", "mark")).alias("p")).select("p.*")
    counted = pairs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    repeated = stored(counted.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("open")))
    anchors = spark.sparkContext.broadcast(key_set(repeated, "anchor"))  # of a fixed size

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = anchors.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                if not len(part):
                    continue
                sizes = part["anchor"].map(len).to_numpy()
                flat = {c: np.concatenate(part[c].to_list()) for c in ("start", "windows", "anchor", "mark")}
                keep = in_key_set(bits, flat["anchor"])
                text, flat = np.repeat(np.arange(len(part)), sizes)[keep], {c: v[keep] for c, v in flat.items()}
                first, starts = distinct_runs(text, flat["anchor"], flat["mark"], flat.pop("start"))
                yield pd.DataFrame({"key": part["key"].to_numpy()[text[first]], "starts": starts, **{c: v[first] for c, v in flat.items()}})

    # exact copies of a text give the same rows, so a run's copies are counted before they are made one
    live = described.mapInPandas(pick, "key binary, starts array<long>, windows int, anchor long, mark long")
    live = live.groupBy("key", "anchor", "mark").agg(F.first("windows").alias("windows"), F.first("starts").alias("starts"), F.count("*").alias("texts"))
    live = stored(live.join(repeated, "anchor").withColumn("places", F.col("texts") * F.size("starts")))
    kinds = live.where("open").groupBy("anchor", "mark").agg(F.sum("places").alias("copies"), F.min(F.struct("key", F.col("starts")[0].alias("start"), "windows")).alias("at"))
    kinds = stored(kinds)
    wanted = kinds.select("at.*", "anchor", "mark", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor", "mark", "copies")).alias("wanted"))
    names = ["anchor", "mark", "copies", "windows", "content"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    content = raw[w["start"] : w["start"] + w["windows"] + span - 1]
                    out.append((w["anchor"], w["mark"], w["copies"], w["windows"], content))
                    size += len(content)
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    contents = keyed.select("key", "text").join(listed, "key").select("text", "wanted").mapInPandas(cut, "anchor long, mark long, copies int, windows int, content binary")
    verdicts = finished(lambda: _verdicts(stored(contents.dropDuplicates(["anchor", "mark"])), span, ANCHORS[1:], many_runs))
    told = live.where("open and places = 1").join(verdicts, ["anchor", "mark"]).select("key", "starts", "windows", "bits")
    whole = live.where("not open or places > 1").select("key", "starts", "windows", F.lit(None).cast("binary").alias("bits"))
    cover = told.unionByName(whole)
    return cover.groupBy("key").agg(F.collect_list(F.struct("starts", "windows", "bits")).alias("cover"))


def _covered(cover, size: int, span: int) -> np.ndarray:
    if cover is None or not len(cover):
        return np.zeros((0, 2), np.int64)
    starts = [np.add.outer(w["starts"], np.arange(w["windows"]) if w["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(w["bits"], np.uint8))[: w["windows"]])).ravel() for w in cover]
    return spans_of(np.concatenate(starts), size, span)


def remove_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, many_runs: int = MANY_RUNS) -> DataFrame:
    """Remove each byte covered by a ``span``-byte string that also starts anywhere else, in any document.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (the other bytes; or kept_sha256 with ``digests``). Overlaps count, and strings are judged on the input. Matches never cross documents. A null text
    is empty; repeated rows repeat each other; other columns are ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    cover = finished(lambda: repeated_windows(keyed, span, many_runs))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, out = batch.iloc[at : at + 1000], []
                for doc, text, own in zip(part["doc_id"], part["text"], part["cover"], strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    spans = _covered(own, len(raw), span)
                    edges = [0, *spans.ravel().tolist(), len(raw)]
                    left = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    out.append((doc, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digests else left))
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}"
    return keyed.join(cover, "key", "left").select("doc_id", "text", "cover").mapInPandas(run, schema)


def without_repeats(docs: DataFrame, span: int = 200, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated strings taken out of the text, and ``size_col`` (if there) to match; all rows stay.

    A cut inside a character drops that character's other bytes too, so the text stays valid UTF-8.
    """
    keyed = _keyed(docs, text_col, text_col)
    cover = finished(lambda: repeated_windows(keyed, span).withColumnRenamed("key", "__key").withColumnRenamed("cover", "__cover"))
    rows = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).join(cover, "__key", "left").select(*map(column, docs.columns), "__cover")
    names = [f"c{k}" for k in range(len(docs.columns))]  # mapInArrow can't take names with dots
    place = names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            own = batch.column("__cover")
            for row in np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = texts[row].encode("utf-8", "surrogatepass")
                edges = [0, *_covered(own[row].as_py(), len(raw), span).ravel().tolist(), len(raw)]
                texts[row] = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]).decode("utf-8", "ignore")
            columns = {name: batch.column(name) for name in batch.schema.names if name != "__cover"}
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_pydict(columns)

    renamed = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema, strict=True)])
    out = rows.toDF(*names, "__cover").mapInArrow(run, renamed).toDF(*docs.columns)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out
