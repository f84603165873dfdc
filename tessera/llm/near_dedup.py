"""MinHash near-dedup with Order MinHash, verified by a banded alignment.

Each text becomes its sequence of ``k``-word runs, labelled by occurrence. A sketch keeps the ``take`` least labelled
runs under one hash function *in their order in the text*; texts that agree in any of ``sketches`` sketches are
candidates. The similarity of two texts is that of the aligned sequences, L / (m + n - L) with L the longest common
subsequence of their runs: the Jaccard similarity of occurrence-labelled runs that also stand in the same order.

Equal word sequences are one node from the start. In each bucket of a sketch, members are compared with its hub, the
member that shares most buckets with others; then, in buckets that still hold several components, the members of others
with the hub; then every pair of a bucket whose texts are in different components, but for those that a bound rules out.
The bound is exact: each text has bitmaps of its hashed runs, and each bit that only one of two texts has is a run that
the other lacks. So pairs within a component are never listed, and no candidate pair that could link two components is
left unverified, whatever the size of its bucket.

To verify pairs, the runs of a pair's second text go to those of its first, which are read once for each of the first
text's parts; parts hold about 512 pairs.

Recall: two texts with n shared of u runs agree in one sketch with probability about (n/u)**take, 0.26 at 0.8, and in
none of 40 with 5e-6. Texts of at most ``short`` runs get as many sketches of three runs more, since few runs make
``take`` of them unlikely: at worst (24 of 30 runs, or 4 of 5) 40 of them miss with 2e-9.

Defined cases: null, empty and white-space texts have no runs, link with nothing and are kept; texts under k words are
one run; equal word sequences are always linked. Rows that share an id but not the text are told apart by a hash of the
text; of each class the row with the least (id, hash) is kept, and if it is repeated, each repetition. Rows with a null
id get their text's class, choose nothing and are kept. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Words, connected_components, dropped, mixed, powers, rolling, text_slices, written

#: Longs of the two bitmaps of a text's runs; the first is the second one folded.
FOLDED, BITMAP = 16, 64
#: Pairs of a first text that are verified in one place, about.
PART = 512

def _labelled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs, made unique by their occurrence."""
    if not len(h):
        return h
    if len(h) < k:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    runs = rolling(h, k)
    order = np.argsort(runs, kind="stable")
    same = runs[order]
    new = np.ones(len(same), dtype=bool)
    new[1:] = same[1:] != same[:-1]
    begun = np.maximum.accumulate(np.where(new, np.arange(len(same)), 0))
    nth = np.empty(len(same), dtype=np.uint64)
    nth[order] = (np.arange(len(same)) - begun).astype(np.uint64)
    return np.where(nth > 0, mixed(runs + nth * np.uint64(0x9FB21C651E98DF25)), runs)


def _sketch(runs: np.ndarray, seeds: np.ndarray, take: int) -> np.ndarray:
    """For each seed, a hash of the ``take`` least runs in text order."""
    take = min(take, len(runs))
    out = []
    step = max(1, (1 << 19) // len(runs))
    for at in range(0, len(seeds), step):
        some = seeds[at : at + step]
        h = runs[None, :] ^ some[:, None]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        picked = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take] if take < len(runs) else np.broadcast_to(np.arange(len(runs)), h.shape), axis=1)
        out.append(mixed((runs[picked] * powers(np.uint64(0xC2B2AE3D27D4EB4F), take)[None, :]).sum(axis=1, dtype=np.uint64) + some))
    return np.concatenate(out)


def _sketched(k: int, sketches: int, take: int, short: int):
    seeds = mixed(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = Words(data, offsets)
                h, raw = words.hashes(), data.tobytes()
                classes, found, sizes = [], [], []
                for d in range(len(rows)):
                    own = h[words.first[d] : words.first[d + 1]]
                    classes.append(hashlib.blake2b(b" ".join(raw[offsets[d] : offsets[d + 1]].split()), digest_size=16).digest() if len(own) else None)
                    sizes.append(max(len(own) - k + 1, min(len(own), 1)))
                    if not len(own):
                        found.append(None)
                        continue
                    runs = _labelled(own, k)
                    keys = _sketch(runs, seeds[:sketches], take)
                    if len(runs) <= short:
                        keys = np.concatenate((keys, _sketch(runs, seeds[sketches:], min(take, 3))))
                    found.append(keys.view(np.int64))
                lengths = [0 if x is None else len(x) for x in found]
                flat = pa.array(np.concatenate([x for x in found if x is not None]) if any(lengths) else np.zeros(0, dtype=np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat)
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(classes, pa.binary()), lists, pa.array(sizes, pa.int32())], names=["id", "t", "class", "sketch", "n"])

    return run


def _bitmap(runs: np.ndarray, longs: int) -> np.ndarray:
    out = np.zeros(longs * 8, np.uint8)
    at = (runs % np.uint64(longs * 64)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out.view(np.int64)


def _runs(k: int):
    """Of each text its labelled runs, their bitmaps, and how many more runs there are than bits in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = Words(data, offsets)
                h = words.hashes()
                found = [_labelled(h[words.first[d] : words.first[d + 1]], k) for d in range(len(rows))]
                cells = [rows.column(0), pa.array([len(r) for r in found], pa.int32()), pa.array([r.tobytes() for r in found], pa.binary())]
                for size in (FOLDED, BITMAP):
                    maps = np.stack([_bitmap(r, size) for r in found])
                    spare = np.array([len(r) for r in found]) - np.bitwise_count(maps.view(np.uint64)).sum(axis=1)
                    cells += [pa.FixedSizeListArray.from_arrays(pa.array(maps.reshape(-1)), size).cast(pa.list_(pa.int64())), pa.array(spare, pa.int32())]
                yield pa.record_batch(cells, names=["node", "n", "runs", "fold", "fold_spare", "bits", "bits_spare"])

    return run


def _aligned(ordered: np.ndarray, places: np.ndarray, b: np.ndarray, least: float) -> int:
    """aligned_runs() with the sorted values of a, and where they stand in a."""
    at = np.minimum(np.searchsorted(ordered, b), len(ordered) - 1)
    own = np.flatnonzero(ordered[at] == b)
    n, total = len(own), len(ordered) + len(b)
    if not n or n < least * (total - n) - 1e-9:
        return 0
    other = places[at[own]]
    if np.all(other[1:] > other[:-1]):  # already in order: the alignment is the shared values
        return n
    tails: list[int] = []
    need = least / (1 + least) * total  # runs that a long enough alignment has at least
    band = int(total - 2 * need) + 1  # and so the widest offset between two aligned places
    near = np.abs(own - other) <= band  # outside the band no alignment is long enough
    for y in other[near].tolist():
        at = bisect_left(tails, y)
        tails[at : at + 1] = [y]
    return len(tails)


def aligned_runs(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Length of the longest common subsequence of two sequences of distinct values, or 0 where that of their shared
    values already rules out the similarity ``least``. Exact for every pair that reaches it."""
    if not len(a) or not len(b):
        return 0
    places = np.argsort(a)
    return _aligned(a[places], places, b, least)


def _verified(least: float):
    """Rows come sorted: those of a first text (b null) and then the second texts of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = places = np.zeros(0, np.uint64)
        for batch in batches:
            seconds, linked = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False)), []
            second = set(seconds.tolist())
            for k, blob in enumerate(batch.column(2)):
                runs = np.frombuffer(blob.as_buffer(), np.uint64)
                if k in second:
                    n = _aligned(ordered, places, runs, least)
                    linked.append(n > 0 and n >= least * (len(ordered) + len(runs) - n) - 1e-9)
                else:
                    places = np.argsort(runs)
                    ordered = runs[places]
            at = pa.array(seconds)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _verify(pairs: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) of pairs (a, b) of nodes."""
    pairs = written(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    second = dealt.join(runs.select(F.col("node").alias("b"), "runs"), "b").select("a", "b", "runs", "part")
    first = parts.join(runs.select(F.col("node").alias("a"), "runs"), "a").select("a", F.lit(None).cast("long").alias("b"), "runs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = written(rows.mapInArrow(_verified(similarity), "a long, b long, linked boolean"), "verified")
    dropped(pairs)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, sketches: int = 40, take: int = 6, short: int = 24, with_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: id, class_id (the smallest id of its group of near copies), kept (whether the row is the least
    of the group) and, with_hash, text_hash (xxhash64 of the text), which tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    sketched = written(source.mapInArrow(_sketched(k, sketches, take, short), "id long, t long, class binary, sketch array<long>, n int"), "sketches")
    classes = sketched.where("id is not null and class is not null").groupBy("class").agg(F.min(F.struct("id", "t")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "class", "row", "n", "sketch"), "nodes")

    def alike(m: Column, n: Column) -> Column:
        """Whether the numbers of runs allow the similarity."""
        return F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9

    keyed = classes.select("node", "n", F.explode("sketch").alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = written(keyed.join(busy, "key"), "keys")
    reach = met.groupBy("node").agg(F.sum("members").alias("reach"))
    hubs = met.join(reach, "node").groupBy("key").agg(F.min(F.struct(-F.col("reach"), "node", "n")).alias("hub"))
    keyed = written(met.join(hubs, "key").select("key", "node", "n", "hub"), "keys")
    dropped(met)
    picked = written(classes.join(keyed.select("node").distinct(), "node").select("node", "row.id", "row.t"), "picked")
    # Always a merge join: what is picked grows with the texts.
    texts = source.join(picked.hint("merge"), ["id", "t"]).groupBy("id", "t", "node").agg(F.first("text").alias("text")).select("node", "text")
    runs = written(texts.mapInArrow(_runs(k), "node long, n int, runs binary, fold array<long>, fold_spare int, bits array<long>, bits_spare int"), "runs")
    dropped(picked)

    # Each text against the hub of its buckets that shares most of them.
    near = keyed.where((F.col("node") != F.col("hub.node")) & alike(F.col("n"), F.col("hub.n")))
    tested = _verify(near.groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("hub")).select(F.col("hub.node").alias("a"), "b"), runs, similarity)
    tables = [sketched, classes, keyed, runs, tested]

    def placed() -> DataFrame:
        """Members of buckets that hold several components, with their own, the hub's and the largest one."""
        parts = connected_components(tested.where("linked").select("a", "b"))
        own = keyed.join(parts.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("key", "node", "n", "hub", F.coalesce("component", "node").alias("part"))
        sizes = own.groupBy("key", "part").agg(F.count("*").alias("c"), F.max(F.col("node") == F.col("hub.node")).alias("hubs"))
        several = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.max_by("part", "hubs").alias("hub_part"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        return own.join(several, "key")

    def fresh(pairs: DataFrame) -> DataFrame:
        listed = written(pairs.distinct(), "listed")
        tables.append(listed)
        return listed.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    hub = F.col("hub.node")
    rows = placed().where((F.col("part") != F.col("hub_part")) & alike(F.col("n"), F.col("hub.n")))
    more = _verify(fresh(rows.select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b"))), runs, similarity)
    tables.append(more)
    tested = tested.union(more)

    # All other pairs of different components. One text of each is outside of the bucket's largest component.
    rows = placed().select("key", "node", "part", "main").join(runs.drop("runs"), "node")
    rows = written(rows, "open")
    tables.append(rows)
    x, y = rows.where("part <> main").alias("x"), rows.alias("y")

    def possible(shared: Column, spare: str) -> Column:
        """Whether so many shared bits allow the similarity: each run that is shared has one, or is spare in both."""
        most = shared + F.least(f"x.{spare}", f"y.{spare}")
        return (1 + similarity) * most >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-9

    folded = F.expr(" + ".join(f"bit_count(x.fold[{i}] & y.fold[{i}])" for i in range(FOLDED)))
    whole = F.expr("aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p & q)), 0, (s, v) -> s + v)")
    apart = (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & alike(F.col("x.n"), F.col("y.n")) & possible(folded, "fold_spare") & possible(whole, "bits_spare"))
    more = _verify(fresh(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))), runs, similarity)
    tables.append(more)
    parts = connected_components(tested.union(more).where("linked").select("a", "b"))

    grouped = classes.select("class", "row", "node").join(parts, "node", "left").select("class", "row", F.coalesce("component", "node").alias("part"))
    least = grouped.groupBy("part").agg(F.min("row").alias("least"))
    least = grouped.select("class", "part").join(least, "part").select("class", "least")
    out = sketched.select("id", "t", "class").join(least, "class", "left")
    class_id = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least.id"))
    kept = F.col("class").isNull() | F.col("id").isNull() | ((F.col("id") == F.col("least.id")) & (F.col("t") == F.col("least.t")))
    out = out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"), F.col("t").alias("text_hash"))
    out = written(out if with_hash else out.drop("text_hash"), "classes")
    for t in tables:
        dropped(t)
    return out
