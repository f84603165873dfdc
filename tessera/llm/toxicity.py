"""Toxicity by classifier chains.

Categories are predicted one after another by linear (logistic) models over hashed word features; each later model also
gets the earlier categories' probabilities. For training these are out-of-fold predictions, so that a later model meets
probabilities as uncertain as those it will get on new texts. Features of a text: each distinct lower-case word and each
distinct word beginning of 4 and 5 bytes, stripped of ASCII punctuation at both ends, hashed to ``2**bits`` columns.

The models are fitted on the driver from at most ``sample_rows`` labelled rows, the ones with the least hash of their
id; each category uses the columns whose presence tells its classes apart (log-likelihood ratio at least
``evidence``), and so not those of single documents. Scoring is one pass over the texts without a shuffle.

Defined cases: null, empty and white-space texts have no features and get the chain's intercepts, which rejects none
(they hold nothing toxic) by rule; null labels are left out of that category's fit; a category with one class gets
that class's rate; ids that repeat among labels use each row, ids that repeat among documents the least text; an empty label table gives probability 0; other columns
are kept as they are in ``score`` (names that clash with the added ones are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm._shared import Words, text_slices

#: Bytes that are stripped from both ends of a word.
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Chain:
    bits: int
    categories: tuple[str, ...]
    weights: list[np.ndarray]  # of each category: 2**bits columns
    links: list[np.ndarray]  # of each category: intercept, then the earlier categories' probabilities


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every distinct feature of every text."""
    words = Words(data, offsets, lower=True)
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none
    for _ in range(4):  # up to four marks at either end
        edge = _EDGE[words.data[words.starts]] & (words.ends - words.starts > 1)
        words.starts = words.starts + edge
        edge = _EDGE[words.data[words.ends - 1]] & (words.ends - words.starts > 1)
        words.ends = words.ends - edge
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    words._inside = np.cumsum(inside[:-1]).astype(bool)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    lengths, columns = words.ends - words.starts, []
    for kind, most in enumerate((None, 4, 5)):
        h = words.hashes(most=most) + np.uint64(kind * 0x51ED270B)
        keep = slice(None) if most is None else lengths > most
        columns.append(owner[keep].astype(np.uint64) << np.uint64(bits) | (h[keep] >> np.uint64(64 - bits)))
    both = np.unique(np.concatenate(columns))
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _telling(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, least: float) -> np.ndarray:
    """Columns whose presence goes with the class: signed log-likelihood ratio (G) of their 2 x 2 counts, or 0."""
    pos, n = y.sum(), len(y)
    here = np.bincount(columns, minlength=width).astype(float)
    both = np.bincount(columns, y[rows], minlength=width)
    g = np.zeros(width)
    for seen, all_ in ((both, pos), (here - both, n - pos)):
        for count, expected in ((seen, here * all_ / n), (all_ - seen, (n - here) * all_ / n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(count > 0, 2 * count * np.log(count / expected), 0)
    return np.where(g >= least, np.where(both * n >= here * pos, g, -g), 0)


def _logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, l2: float, evidence: float, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the columns and of (1, extra) for class-balanced logistic loss; full-batch Adam, so deterministic."""
    use = np.flatnonzero(_telling(rows, columns, y, width, evidence))
    place = np.full(width, -1, dtype=np.int32)
    place[use] = np.arange(len(use))
    keep = place[columns] >= 0
    r, c = rows[keep].astype(np.intp), place[columns[keep]].astype(np.intp)
    w, v = np.zeros(len(use)), np.zeros(1 + extra.shape[1])
    x = np.column_stack((np.ones(n), extra))
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    first, second = [np.zeros(len(w)), np.zeros(len(v))], [np.zeros(len(w)), np.zeros(len(v))]
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], minlength=n) + x @ v
        g = share * (_probability(z) - y)
        for k, (p, grad) in enumerate(((w, np.bincount(c, g[r], minlength=len(w)) + l2 * w), (v, x.T @ g + np.concatenate(([0], l2 * v[1:]))))):
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad**2 - second[k])
            p -= 0.05 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(width)
    out[use] = w
    return out, v


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, bits: int = 16, folds: int = 4, l2: float = 3e-5, evidence: float = 12.0) -> Chain:
    """A chain over ``categories`` (name, 0/1 column of ``labels``), in that order."""
    ys = [c.cast("double").alias(f"y{i}") for i, (_, c) in enumerate(categories)]
    named = [f"y{i}" for i in range(len(ys))]
    rows = labels.where(F.col(id_col).isNotNull()).select(F.crc32(F.col(id_col).cast("string")).alias("_h"), F.col(id_col).alias("_id"), *ys)
    picked = rows.orderBy("_h", "_id", *named).limit(sample_rows)  # at most sample_rows rows, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # One text, the least, of an id that several documents have: no more texts than label rows reach the driver.
    one = texts.join(F.broadcast(picked.select("_id").distinct()), "_id").groupBy("_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    pdf = one.join(F.broadcast(picked), "_id").select("_h", "_id", "text", *named).toArrow().sort_by([("_h", "ascending"), ("_id", "ascending"), *((y, "ascending") for y in named)])
    n, width = pdf.num_rows, 1 << bits
    rows, columns, done = [], [], 0
    for batch in pdf.combine_chunks().to_batches():
        for part, data, offsets in text_slices(batch):
            r, c = features(data, offsets, bits)
            rows.append((r + done).astype(np.int32))
            columns.append(c.astype(np.int32))
            done += part.num_rows
    r = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    c = np.concatenate(columns) if columns else np.zeros(0, dtype=np.int32)
    del rows, columns
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    chain = Chain(bits, tuple(name for name, _ in categories), [], [])
    for i in range(len(categories)):
        y = pdf.column(f"y{i}").to_pandas().to_numpy(dtype=float) if n else np.zeros(0)
        known = ~np.isnan(y)

        def fitted(use: np.ndarray, y=y, earlier=earlier) -> tuple[np.ndarray, np.ndarray]:
            if not use.any() or len(set(y[use])) < 2:
                rate = float(y[use].mean()) if use.any() else 0.0
                return np.zeros(width), np.concatenate(([np.log((rate + 1e-6) / (1 - rate + 1e-6))], np.zeros(earlier.shape[1])))
            new = np.cumsum(use) - 1
            keep = use[r]
            return _logistic(new[r[keep]], c[keep], int(use.sum()), width, earlier[use], y[use], l2, evidence)

        out_of_fold = np.zeros(n)
        for f in range(folds):
            w, v = fitted(known & (fold != f))
            z = np.bincount(r, w[c], minlength=n) + v[0] + earlier @ v[1:]
            out_of_fold[fold == f] = z[fold == f]
        w, v = fitted(known)
        chain.weights.append(w)
        chain.links.append(v)
        earlier = np.column_stack((earlier, _probability(out_of_fold)))
    return chain


def _scores(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each category for each text."""
    n = len(offsets) - 1
    r, c = features(data, offsets, chain.bits)
    out = np.zeros((n, 0))
    for w, v in zip(chain.weights, chain.links, strict=True):
        out = np.column_stack((out, _probability(np.bincount(r, w[c], minlength=n) + v[0] + out @ v[1:])))
    out[np.bincount(r, minlength=n) == 0] = 0.0  # a text without a word holds nothing toxic
    return out


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` (double) for every category."""
    names = [f"p_{c}" for c in chain.categories]
    taken = {n.lower() for n in names}
    kept = docs.select(*(c for c in docs.columns if c.lower() not in taken))
    held = kept.sparkSession.sparkContext.broadcast(chain)  # 2**bits weights a category, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text_col):
                out = _scores(own, data, offsets)
                yield pa.record_batch([*rows.columns, *(pa.array(out[:, i]) for i in range(len(names)))], names=[*rows.schema.names, *names])

    schema = StructType([*kept.schema.fields, *(StructField(name, DoubleType()) for name in names)])
    return kept.mapInArrow(run, schema)
