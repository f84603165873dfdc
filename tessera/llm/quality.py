"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts turns each into a few statistics (word and line shape, letter case, marks, repetition), shares
on a logit scale and counts on a log scale. Class means and covariances come from sums over all labelled training rows.
Each covariance is shrunk to the pooled one and that to its diagonal; its Cholesky factor is cached. The score is the
logistic of a linear function of the Mahalanobis log-density difference, fitted so that the classes weigh alike.

Defined cases: null, empty and white-space texts have statistics of their own (zero words) and get a score; null ids
are held_out false and are scored; null labels and labels without a document are left out; labels that repeat count
each; without both classes among the labels every score is the share of label 1 (0.5 without labels); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Words, text_slices, written

STATISTICS = ("log_words", "log_word_length", "upper", "marks", "symbols", "digits", "bars", "wide", "distinct_words", "same_as_last", "distinct_pairs", "line_repeats", "log_line_length", "stops")

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or other letters, 3 digit, 4 common marks, 5 symbols
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[*b".,;:'\"-()?"]] = 4
_KIND[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on the logit scale, with half a case added to either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    lead = np.zeros(len(data), dtype=bool)
    lead[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)  # two-byte Latin letters
    kind = np.where(lead & (data <= 0x9E), 1, np.where(lead, 2, kind))
    upper, lower, digits, marks, symbols = (_per(owner[kind == k], n) for k in range(1, 6))
    bars = _per(owner[data == 0x7C], n)
    wide = _per(owner[data >= 0xE0], n)
    words = Words(data, offsets)
    h, count = words.hashes(), words.counts().astype(float)
    who = np.repeat(np.arange(n), words.counts())
    salt = (who.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(n)
        _, first = np.unique(x, return_index=True)
        return _per(of[first], n)

    next_ = who[1:] == who[:-1] if len(who) else np.zeros(0, dtype=bool)
    same = _per(who[1:][next_ & (h[1:] == h[:-1])], n) if len(who) else np.zeros(n)
    pairs = ((h[1:] * np.uint64(3) + h[:-1]) ^ salt[1:])[next_] if len(who) else np.zeros(0, dtype=np.uint64)
    pair_count = np.maximum(count - 1, 0)
    # lines, as runs between line ends, by a hash of their words
    breaks = np.flatnonzero(data == 0x0A)
    lines = np.searchsorted(breaks, words.starts) + np.int64(0) if len(words) else np.zeros(0, dtype=np.int64)
    if len(words):
        new = np.ones(len(who), dtype=bool)
        new[1:] = (lines[1:] != lines[:-1]) | ~next_
        at = np.flatnonzero(new)
        place = np.arange(len(who)) - np.repeat(at, np.diff(np.append(at, len(who))))
        line = np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at) ^ salt[at]
        line_count, line_distinct = _per(who[at], n), distinct(line, who[at])
    else:
        line_count = line_distinct = np.zeros(n)
    stops = _per(who[words.data[words.ends - 1] == 0x2E], n) if len(words) else np.zeros(n)
    letters = upper + lower
    return np.column_stack(
        (
            np.log1p(count),
            np.log1p(letters / np.maximum(count, 1)),
            _share(upper, letters),
            _share(marks, size),
            _share(symbols, size),
            _share(digits, size),
            _share(bars, count),
            _share(wide, size),
            _share(distinct(h ^ salt, who), count),
            _share(same, pair_count),
            _share(distinct(pairs, who[1:][next_] if len(who) else who), pair_count),
            _share(line_count - line_distinct, line_count),
            np.log1p(count / np.maximum(line_count, 1)),
            _share(stops, count),
        )
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            x = statistics(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([rows.column(0), rows.column(2), flat], names=["id", "held", "x"])


@dataclass
class Discriminant:
    means: list[np.ndarray]  # of classes 0 and 1
    factors: list[np.ndarray]  # inverses of the Cholesky factors of their covariances
    logdets: list[float]
    line: tuple[float, float]  # log-odds = line[0] + line[1] * log-density difference

    def difference(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            out.append(-0.5 * ((z**2).sum(axis=1) + logdet))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.line[0] + self.line[1] * self.difference(x) if self.factors else np.full(len(x), self.line[0])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' by class, as (class, place, value)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.column_stack((np.ones(len(y)), np.stack(batch.column(1).to_pylist()))) if len(y) else np.zeros((0, 1 + len(STATISTICS)))
        for c in (0, 1):
            total[c] = total.get(c, 0) + x[y == c].T @ x[y == c]
    for c, s in total.items():
        yield pa.record_batch([pa.array(np.full(s.size, c, dtype=np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["y", "place", "value"])


def fitted(labelled: DataFrame, to_pooled: float = 0.2, to_diagonal: float = 0.05) -> Discriminant:
    """From rows (y, x): the moments are summed in Spark, so all rows count and the driver gets two small matrices."""
    d = 1 + len(STATISTICS)
    moments = np.zeros((2, d * d))
    for r in labelled.select(F.col("y").cast("int").alias("y"), "x").mapInArrow(_sums, "y int, place int, value double").groupBy("y", "place").agg(F.sum("value").alias("value")).collect():
        moments[r["y"], r["place"]] = r["value"]
    moments = moments.reshape(2, d, d)
    n = moments[:, 0, 0]
    if n.min() < 2:
        rate = (n[1] + 0.5) / (n.sum() + 1)
        return Discriminant([], [], [], (float(np.log(rate / (1 - rate))), 0.0))
    means = [m[0, 1:] / k for m, k in zip(moments, n, strict=True)]
    scatter = [m[1:, 1:] - k * np.outer(u, u) for m, k, u in zip(moments, n, means, strict=True)]
    pooled = sum(scatter) / n.sum()
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d - 1)
    factors, logdets = [], []
    for s, k in zip(scatter, n, strict=True):
        # few rows lean on the pooled covariance more
        a = max(to_pooled, min(1.0, 3.0 * d / k))
        own = (1 - to_diagonal) * s / k + to_diagonal * np.diag(np.diag(s / k))
        chol = np.linalg.cholesky((1 - a) * own + a * pooled)
        factors.append(np.linalg.inv(chol))
        logdets.append(float(2 * np.log(np.diag(chol)).sum()))
    return Discriminant(means, factors, logdets, (0.0, 1.0))


def _calibrated(model: Discriminant, labelled: DataFrame) -> Discriminant:
    """Line from the log-density difference to log-odds: its class means and spreads, each class weighing alike."""
    if not model.factors:
        return model
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.record_batch([batch.column(0), pa.array(np.clip(held.value.difference(x), -60, 60))], names=["y", "z"])

    z = labelled.select(F.col("y").cast("int").alias("y"), "x").mapInArrow(run, "y int, z double")
    found = {r["y"]: (r["m"], r["v"] or 0.0) for r in z.groupBy("y").agg(F.avg("z").alias("m"), F.var_pop("z").alias("v")).collect()}
    (m0, v0), (m1, v1) = found[0], found[1]
    slope = max(m1 - m0, 1e-6) / max(0.5 * (v0 + v1), 1.0)
    s0, s1 = np.sqrt(v0) + 1e-3, np.sqrt(v1) + 1e-3
    middle = (m0 * s1 + m1 * s0) / (s0 + s1)  # as many spreads from either mean
    return Discriminant(model.means, model.factors, model.logdets, (float(-slope * middle), float(slope)))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, held_out, score. ``held_out`` (of docs) marks ids whose labels are not learned from."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    id_type = source.schema["id"].dataType.simpleString()
    measured = written(source.mapInArrow(_measured, f"id {id_type}, held boolean, x array<double>"), "statistics")
    y = labels.select(F.col(id_col).alias("id"), label.cast("int").alias("y")).where("id is not null and y in (0, 1)")
    labelled = measured.where("not held").join(y, "id").select("y", "x")
    model = docs.sparkSession.sparkContext.broadcast(_calibrated(fitted(labelled), labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(model.value.score(x))], names=["id", "held_out", "score"])

    return measured.mapInArrow(run, f"id {id_type}, held_out boolean, score double").withColumnRenamed("id", id_col)
