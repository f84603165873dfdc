"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark, merged into removal intervals.

A window of ``size`` words is removed from a document if the same word sequence also starts in a document with a
smaller id. Two steps keep the counted rows few without losing a window. Whole copies of a text with a smaller id lose
all their windows, so only the first of each text is compared further. Identical windows have the same minimiser (the
least hash among their half-size word runs), so only windows whose minimiser stands in two texts can repeat, and only
their Rabin-Karp hashes (64 + 32 bits) are counted.

Defined cases: null and empty texts have no words and lose none; texts under ``size`` words lose none; a document that
repeats itself keeps its windows; rows that share an id don't remove from each other and are all returned; a null id
keeps all of its words and removes from nobody; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Words, dropped, mixed, rolling, text_slices, written

_SECOND = np.uint64(0xA0761D6478BD642F)


def _least_of(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    n, width = len(x) - size + 1, 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[size - width : size - width + n]) if width < size else x


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each whole window: its first word's index, its text's index, its minimiser."""
    h = words.hashes()
    if len(h) < size:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    part = max(1, size // 2)
    least = _least_of(rolling(h, part), size - part + 1)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    at = np.flatnonzero(owner[: len(least)] == owner[size - 1 :])
    return at, owner[at], least[at]


def _minimisers(size: int):
    """For each text its digest and its windows' minimisers; texts without a window are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = Words(data, offsets)
                _, owner, least = _windows(words, size)
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
                count = np.bincount(owner[new], minlength=rows.num_rows) if len(owner) else np.zeros(rows.num_rows, dtype=np.int64)
                some, raw = np.flatnonzero(count), data.tobytes()
                digests = [hashlib.blake2b(b" ".join(raw[offsets[d] : offsets[d + 1]].split()), digest_size=16).digest() for d in some]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[some]))).astype(np.int32)), pa.array(least[new].view(np.int64)))
                yield pa.record_batch([rows.column(0).take(pa.array(some)), rows.column(2).take(pa.array(some)), pa.array(digests, pa.binary()), lists], names=["id", "k", "digest", "ms"])

    return run


def _shared_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                k = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
                lists = rows.column(3)
                words = Words(data, offsets)
                at, owner, least = _windows(words, size)
                if not len(at):
                    continue
                held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                salt = lambda who, m: mixed(m + mixed(who.astype(np.uint64) + np.uint64(1)))
                keep = np.isin(salt(owner, least), salt(of, held))
                at, owner, least = at[keep], owner[keep], least[keep]
                h = words.hashes()
                full = rolling(h, size)[at]
                second = (rolling(mixed(h ^ _SECOND), size, _SECOND)[at] >> np.uint64(33)).astype(np.int32)
                yield pa.record_batch([pa.array(full.view(np.int64)), pa.array(second), pa.array(ids[owner]), pa.array(k[owner]), pa.array((at - words.first[owner]).astype(np.int32))], names=["h", "g", "id", "k", "pos"])

    return run


def merged(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that windows at these starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + size).tolist(), strict=True))


def text_hash(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.hash(text.cast("string"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.cast("string").alias("text"), text_hash(text).alias("k"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(id, k, whole, starts array<int>): the windows that a document with a smaller id holds too; whole: all of them."""
    source = _source(docs, id_col, text_col).where("id is not null")
    texts = written(source.mapInArrow(_minimisers(size), "id long, k int, digest binary, ms array<long>"), "minimisers")
    copied = texts.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("digest", "lo")
    marked = texts.select("id", "k", "digest").join(copied, "digest").where("id > lo").select("id", "k").distinct()
    copies = written(marked, "copies")
    least = texts.select("id", "k", "ms").join(copies, ["id", "k"], "left_anti").select("id", "k", F.explode("ms").alias("m"))
    seen = least.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("m")
    per_doc = least.join(seen, "m").groupBy("id", "k").agg(F.collect_set("m").alias("shared"))  # bounded by the document's own length
    rows = written(source.join(per_doc, ["id", "k"]).select("id", "text", "k", "shared").mapInArrow(_shared_windows(size), "h long, g int, id long, k int, pos int"), "windows")
    first = rows.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "g", "lo")
    found = rows.join(first, ["h", "g"]).where("id > lo").groupBy("id", "k").agg(F.collect_set("pos").alias("starts"))
    whole = copies.select("id", "k", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    out = written(whole.unionByName(found.withColumn("whole", F.lit(False))), "removals")
    for t in (texts, copies, rows):
        dropped(t)
    return out


def _apply(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            cols: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for text, starts, whole in zip(batch.column(at), batch.column(batch.schema.get_field_index("starts")), batch.column(batch.schema.get_field_index("whole")), strict=True):
                words = (text.as_py() or "").encode().split()
                spans = [(0, len(words))] if whole.as_py() else merged(np.asarray(starts.as_py(), dtype=np.int64), size) if starts.is_valid else []
                kept, last = [], 0
                for lo, hi in spans:
                    kept += words[last:lo]
                    last = hi
                kept = kept + words[last:] if spans else words
                joined = b" ".join(kept)
                for col, value in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), spans, joined.decode() if with_text else None), strict=True):
                    col.append(value)
            arrays = [batch.column(0), batch.column(batch.schema.get_field_index("k")), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in cols[3]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            names = ["id", "text_hash", "n_words", "n_removed", "kept_sha256", "removed"]
            if with_text:
                arrays, names = [*arrays, pa.array(cols[4], pa.string())], [*names, "kept"]
            yield pa.record_batch(arrays, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, text_hash, n_words, n_removed, kept_sha256, removed (maximal word intervals) and,
    with_text, kept."""
    found = removals(docs, id_col, text_col, size)
    joined = _source(docs, id_col, text_col).join(found, ["id", "k"], "left").select("id", "text", "k", "starts", "whole")
    schema = "id long, text_hash int, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"
    return joined.mapInArrow(_apply(size, with_text), schema + ", kept string" * with_text).withColumnRenamed("id", id_col)
