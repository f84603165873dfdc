"""What the operators of this subpackage share: the cluster's shared folder, Arrow text scanning and components.

Work tables go to the folder named by ``spark.checkpoint.dir``, which every executor can read, so a lost executor
costs a re-read and no recomputation of what was written.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20
#: Bytes of text whose words are hashed at a time.
_BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where the session names none, a temporary one for a local
    master, which has one machine; an error for a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a work table to the shared folder and read it back, which cuts its lineage; what was shuffled for it goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    released(spark)
    return out


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished checkpoints now; it acts on the driver's garbage
    collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete a work table of ``written`` that no later result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts. starts, ends: bytes of each word in data; first: for each text the
    index of its first word, and one more entry at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data = data
        n = len(data)
        inside = ~_SEPARATOR[data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = offsets[1:] > offsets[:-1]
            at = offsets[:-1][full]
            begin[at] = inside[at]
            at = offsets[1:][full] - 1
            end[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: np.uint64 = _BASE, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        out = np.empty(len(self.starts), dtype=np.uint64)
        lo = 0
        while lo < len(out):  # some words at a time, so that what is held for each byte stays small
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + _BLOCK_BYTES)))
            begin, end = self.starts[lo], self.ends[hi - 1]
            lengths = self.ends[lo:hi] - self.starts[lo:hi]
            at = np.flatnonzero(self._inside[begin:end])  # every byte of every word, in order
            offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(len(at)) - np.repeat(offset, lengths)
            part = (self.data[begin:end][at].astype(np.uint64) + np.uint64(1)) * powers(base, int(lengths.max()))[place]
            if most:
                part[place >= most] = 0
                lengths = np.minimum(lengths, most)
            out[lo:hi] = mixed(np.add.reduceat(part, offset) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            lo = hi
        return out


def rolling(h: np.ndarray, size: int, base: np.uint64 = np.uint64(0xC2B2AE3D27D4EB4F)) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every run of ``size`` values, one for each start."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    scaled = np.cumsum(h * powers(base, len(h)), dtype=np.uint64)
    scaled[size:] = scaled[size:] - scaled[:-size]
    return mixed(scaled[size - 1 :] * powers(inverse(base), len(h) - size + 1))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``most`` bytes of text each: rows, the bytes, and offsets (a null text is empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        lo, hi = offsets[row], offsets[end]
        yield batch.slice(row, end - row), data[lo:hi], offsets[row : end + 1] - lo
        row = end


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (a long, b long).

    Alternates large-star and small-star steps with aggregates and joins; no group is collected. Each step is
    checkpointed. Self-links, repeated links and empty input are fine.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(down.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        links = checkpointed(kept.union(down.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
