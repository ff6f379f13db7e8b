"""Quality classifier: document statistics, random Fourier features, ridge scores, isotonic calibration.

One pass over the texts makes a short vector of statistics for each document, which is written to the shared folder.
Training and scoring read only that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, ids_and_texts, stored

FEATURES = 256
#: Width of the Gaussian kernel over standardised statistics, and the ridge for each training row.
KERNEL_WIDTH = 4.0
RIDGE = 1e-4
#: Cells of the raw score between -1 and 2, within which calibration counts rows and labels.
CELLS = 3_000
SEED = 20240917
#: Texts that a task holds as Python strings at once.
AT_ONCE = 250

#: Byte classes, each a statistic; bytes from 128 on and those not named are classes of their own.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:'\"-()", b"!?", b"|<>{}[]\\/", b"#$%&*+=@^_~`")
NAMES = ("lower", "upper", "digit", "space", "stop", "shout", "bracket", "symbol", "high", "other", "size", "word", "short", "long", "distinct", "line", "twice")


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``NAMES`` for each text: byte class shares, sizes, and word and line repetition."""
    kinds = np.full(256, len(CLASSES) + 1, np.int64)
    for k, own in enumerate(CLASSES):
        kinds[list(own)] = k
    kinds[128:] = len(CLASSES)
    n = len(CLASSES) + 2
    out = np.zeros((len(texts), len(NAMES)))
    for first, end, data, starts in byte_slices(texts):
        size = np.diff(starts)
        own = np.repeat(np.arange(end - first) * n, size)
        own += kinds[np.frombuffer(data, np.uint8)]
        shares = np.bincount(own, minlength=(end - first) * n).reshape(-1, n)
        out[first:end, :n] = shares / np.maximum(size, 1)[:, None]
        out[first:end, n] = np.log1p(size)
    for row, text in enumerate(texts):
        words = (text or "").split()
        if words:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            lines = text.split("\n")
            out[row, n + 1 :] = (lengths.mean(), (lengths <= 3).mean(), math.log(lengths.max()), len(set(words)) / len(words), math.log(len(words) / len(lines)), 1 - len(set(lines)) / len(lines))
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(list(statistics(part.column(1).to_pylist())), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Model:
    """Everything a score needs; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(SEED)
        directions = random.normal(size=(stats.shape[1], FEATURES)) / KERNEL_WIDTH
        phases = random.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ directions + phases) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.levels[0])
        raw = self.raw(stats)
        # a hundredth of the raw score keeps the order inside a calibrated step
        return 0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells in order of x: (mean x, mean label) of each pool, labels not falling."""
    pools: list[list[float]] = []
    for place, n, y in zip(x, total, ones, strict=True):
        pools.append([place * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Column sums of each task's matrix, added up by row number; ``make`` turns (stats, labels) into a matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                own = make(np.stack(batch["stats"].to_numpy()), batch["quality"].to_numpy(float))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [group["i"].iloc[0]], "v": [np.sum(group["v"].tolist(), axis=0)]})

    parts = rows.select("stats", "quality").mapInPandas(partial, "i int, v array<double>")
    found = parts.groupBy("i").applyInPandas(add, "i int, v array<double>").collect()  # a matrix of fixed size
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, width))
    for r in found:
        out[r["i"]] = r["v"]
    return out


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out.

    stats: (doc_id, stats); labels: (doc_id, quality). Repeated labels of a document are averaged. Ridge weights come
    from normal equations summed over tasks; a third of the rows (crc32 modulo 4 is 3) is left for calibration, which
    sees counts in CELLS cells of the raw score. Without labelled rows every score is 0.5.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = stored(stats.join(known, "doc_id").where(~held_out(F.col("doc_id"))))
    # the part for calibration is also fitted if it is all there is
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3
    d = len(NAMES)
    moments = _sums(rows, lambda x, y: np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(d, len(x)), np.full(d, y.sum())]), d)
    if not len(moments):
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.zeros(0), np.array([0.5]))
    n = moments[2, 0]
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 1e-8)), np.zeros(FEATURES + 1), np.zeros(0), np.array([moments[3, 0] / n]))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _sums(rows.where(~apart), equations, FEATURES + 2)
    if not len(sums):
        return model
    # ones are far more common, so the constant takes the mean and only the rest is held small
    ridge = np.eye(FEATURES + 1) * RIDGE * sums[-1, FEATURES]
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(sums[:, :-1] + ridge, sums[:, -1])

    def cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(model.raw(x), -1, 2)
        at = np.minimum(((raw + 1) * CELLS / 3).astype(int), CELLS - 1)
        return np.vstack([np.bincount(at, minlength=CELLS), np.bincount(at, weights=y, minlength=CELLS), np.bincount(at, weights=raw, minlength=CELLS)])

    found = _sums(rows.where(apart), cells, CELLS)
    if len(found):
        full = found[0] > 0
        model.knots, model.levels = isotonic(found[2, full] / found[0, full], found[0, full], found[1, full])
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, stats)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": np.clip(model.score(np.stack(batch["stats"].to_numpy())), 0, 1)})

    return stats.mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the statistics 0 and are scored like any other. Rows and repeated ids are kept; lang,
    source and ids are never inputs of a score; an empty table gives no rows.
    """
    stats = stored(document_statistics(docs, id_col, text_col))
    return score(stats, train(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose score is at least ``threshold``, with all their columns; all rows if nothing is labelled."""
    model = train(stored(document_statistics(docs, id_col, text_col)), labels)
    if not len(model.knots):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield part.filter(pa.array(model.score(statistics(part.column(text_col).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
