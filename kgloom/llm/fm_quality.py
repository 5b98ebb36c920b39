"""Quality score by a factorisation machine over hashed words, structure statistics and length metadata.

``y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)``: all pairwise interactions at
a cost linear in the text's distinct words.  Words are hashed to 2**18 columns with log counts, scaled to unit
length; statistics are standardised; length is a one-hot bucket.  The model is fitted on the driver on at
most ``max_rows`` labelled texts, whose sparse features (not texts) are collected; scoring maps over all rows.

Defined cases: a null text is empty and scored by its statistics; with no labelled rows, or one class only, every
score is the share of label 1 (0.5 with none); long texts are read whole; equal rows score alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import U, slices
from .features import STRUCTURE, sample_rows, sigmoid, word_statistics

WORD_BITS = 18
LENGTH_BUCKETS = 20
N_COLUMNS = (1 << WORD_BITS) + len(STRUCTURE) + LENGTH_BUCKETS


def sparse_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values and row offsets; statistics are as they are, not yet standardised."""
    words, counts, at, stats = word_statistics(column)
    n, s = len(at) - 1, stats.shape[1]
    value = np.log1p(counts)
    norm = np.sqrt(np.add.reduceat(np.append(value**2, 0), at[:-1])) if n else np.zeros(0)
    norm[np.diff(at) == 0] = 1
    size = np.diff(at) + s + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    columns, values = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.float32)
    place = np.arange(len(words)) + np.repeat(offsets[:-1] - at[:-1], np.diff(at))
    columns[place] = (words >> U(64 - WORD_BITS)).astype(np.int32)
    values[place] = value / np.repeat(norm, np.diff(at))
    tail = offsets[1:, None] - s - 1 + np.arange(s)
    columns[tail] = (1 << WORD_BITS) + np.arange(s)
    values[tail] = stats
    columns[offsets[1:] - 1] = (1 << WORD_BITS) + s + np.minimum(LENGTH_BUCKETS - 1, stats[:, 0]).astype(np.int32)
    values[offsets[1:] - 1] = 1
    return columns, values, offsets


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standardised(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = columns - (1 << WORD_BITS)
        stat = (at >= 0) & (at < len(STRUCTURE))
        out = values.copy()
        out[stat] = np.clip((values[stat] - self.mean[at[stat]]) / self.scale[at[stat]], -5, 5)
        return out

    def raw(self, columns: np.ndarray, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and what the gradient needs; every row has at least one column."""
        vx = self.v[columns] * x[:, None]
        summed = np.add.reduceat(vx, offsets[:-1], axis=0)
        squares = np.add.reduceat(vx**2, offsets[:-1], axis=0)
        return self.bias + np.add.reduceat(self.w[columns] * x, offsets[:-1]) + 0.5 * (summed**2 - squares).sum(1), vx, summed

    def score(self, column) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._score(part) for part in slices(column))])

    def _score(self, column) -> np.ndarray:
        columns, values, offsets = sparse_rows(column)
        out, i = np.zeros(len(offsets) - 1), 0
        if not np.isfinite(self.bias):  # fitted on nothing: a constant
            return np.full(len(out), 1.0 if self.bias > 0 else 0.0 if self.bias < 0 else 0.5)
        while i < len(out):  # some rows at a time: a row of factors for each distinct word
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 500_000, "right")) - 1)
            part = slice(offsets[i], offsets[j])
            out[i:j] = self.raw(columns[part], self.standardised(columns[part], values[part]), offsets[i : j + 1] - offsets[i])[0]
            i = j
        return sigmoid(out)


def fit(columns: np.ndarray, values: np.ndarray, offsets: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 2e-5, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in batches of 128 rows."""
    rng = np.random.default_rng(seed)
    stats = len(STRUCTURE)
    tail = offsets[1:, None] - stats - 1 + np.arange(stats)
    table = values[tail] if len(y) else np.zeros((1, stats))
    share = float(y.mean()) if len(y) else 0.5
    bias = np.log(share / (1 - share)) if 0 < share < 1 else np.inf if share == 1 else -np.inf
    fm = FactorisationMachine(bias, np.zeros(N_COLUMNS, np.float32), (rng.standard_normal((N_COLUMNS, rank)) * 0.02).astype(np.float32), table.mean(0), table.std(0) + 1e-6)
    if not len(y):
        fm.bias = np.nan
    if not np.isfinite(fm.bias):
        return fm
    x = fm.standardised(columns, values)
    gw, gv, gb = np.full(N_COLUMNS, 1e-3, np.float32), np.full((N_COLUMNS, rank), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            size = offsets[rows + 1] - offsets[rows]
            at = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(offsets[rows] - at[:-1], size) + np.arange(at[-1])
            c, xv = columns[place], x[place]
            raw, vx, summed = fm.raw(c, xv, at)
            err = ((sigmoid(raw) - y[rows]) / len(rows)).astype(np.float32)
            e = np.repeat(err, size)
            dv = (e * xv)[:, None] * (np.repeat(summed, size, axis=0) - vx)
            used, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, e * xv, len(used)).astype(np.float32) + decay * fm.w[used]
            dvs = np.stack([np.bincount(inv, dv[:, f], len(used)) for f in range(rank)], 1).astype(np.float32) + decay * fm.v[used]
            gw[used] += dw**2
            gv[used] += dvs**2
            fm.w[used] -= rate * dw / np.sqrt(gw[used])
            fm.v[used] -= rate * dvs / np.sqrt(gv[used])
            gb += float(err.sum()) ** 2
            fm.bias -= rate * float(err.sum()) / np.sqrt(gb)
    return fm


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_rows: int = 8000, **settings) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows of those that ``usable`` (of doc_id) leaves."""
    chosen = sample_rows(labels.filter(usable) if usable is not None else labels, [label], max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, values, offsets = sparse_rows(batch.column("text"))
            off = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(off, pa.array(columns)), pa.ListArray.from_arrays(off, pa.array(values))], names=["doc_id", "y", "columns", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.withColumnRenamed(label, "y")), "doc_id")
    rows = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, columns array<int>, values array<float>").toArrow().sort_by("doc_id").combine_chunks()
    parts = [(x.flatten().to_numpy(), x) for x in (rows["columns"].combine_chunks(), rows["values"].combine_chunks())] if rows.num_rows else []
    if not parts:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0), **settings)
    size = np.asarray(parts[0][1].value_lengths())
    return fit(parts[0][0], parts[1][0], np.concatenate([[0], np.cumsum(size)]), rows["y"].to_numpy().astype(float), **settings)


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
