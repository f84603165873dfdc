"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine at least ``cosine`` lie within eps = sqrt(2 - 2 cosine). Projections on leading principal
dimensions never lengthen a distance, so vectors are sorted by label and by their grid cells of width eps on these
dimensions, and cut into blocks. Intervals of that sequence are joined recursively, from a few large ones down to
blocks, and within a task from a block's halves down to small leaves; a pair of intervals whose bounding boxes are
further apart than eps is skipped. Leaves compare all their pairs in double precision.

Exact copies are one node from the start. A task gives each node's number of links and one link to the least node it
reaches in the two blocks, so a group of g near copies costs O(g) rows; no link is dropped.

Defined cases: vectors that are null, empty or zero, hold null or non-finite components or have a null label link with
nothing and are their own component; vectors of different length link with nothing; rows that share an id are separate
vectors with one component id space; a null id gives a null component unless it is linked; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import checkpointed, connected_components, dropped, written

#: Rows of a block, and of the leaves that the recursion within a task ends at.
BLOCK, LEAF = 1024, 128
#: Intervals that the next larger one consists of.
FAN = 4
#: Leading principal dimensions, and the coordinates they are found among (any orthonormal directions are right).
LEADING, AMONG = 8, 256


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles and a digest of the vector, null where a vector links with nothing."""
    for batch in batches:
        keys, units, sizes = [], [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ok = label is not None and v and None not in v
            x = np.asarray(v, dtype=np.float64) + 0.0 if ok else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not len(x) or not np.isfinite(x).all() or top == 0:
                keys.append(None), units.append(None), sizes.append(None)
                continue
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            x = x / top  # against overflow of the squares
            units.append((x / math.sqrt(float(x @ x))).tobytes())
            sizes.append(len(x))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "label", "key", "unit", "dim"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.append(np.frombuffer(unit)[:AMONG], 1.0)
            total[dim] = total.get(dim, 0.0) + np.outer(x, x)
    for dim, s in total.items():
        yield pa.record_batch([pa.array(np.full(s.size, dim, dtype=np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "place", "value"])


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length, from sums over all vectors."""
    sums: dict[int, dict[int, float]] = {}
    for r in nodes.select("dim", "unit").mapInArrow(_moments, "dim int, place int, value double").groupBy("dim", "place").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(r["dim"], {})[r["place"]] = r["value"]
    out = {}
    for dim, s in sums.items():
        n = math.isqrt(len(s))
        m = np.array([s[i] for i in range(n * n)]).reshape(n, n)
        mean = m[-1, :-1] / m[-1, -1]
        _, vectors = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[dim] = vectors[:, ::-1][:, :LEADING]
    return out


def _placed(axes, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, unit in zip(batch.column(batch.schema.get_field_index("dim")).to_pylist(), batch.column(batch.schema.get_field_index("unit")).to_pylist(), strict=True):
                x = np.frombuffer(unit)[:AMONG] @ axes.value[dim]
                cells.append(np.floor(np.pad(x, (0, LEADING - len(x))) / eps).astype(np.int32))
            both = np.stack(cells) if cells else np.zeros((0, LEADING), dtype=np.int32)
            yield pa.record_batch([*batch.columns, *(pa.array(both[:, i]) for i in range(LEADING))], names=[*batch.schema.names, *(f"c{i}" for i in range(LEADING))])

    return run


def _blocks(axes):
    """Cuts a sorted partition into blocks of one label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rest, kind = TaskContext.get().partitionId(), 0, [], None

        def block(rows: list) -> pa.RecordBatch:
            nonlocal made
            label, dim = rows[0][:2]
            x = np.stack([np.frombuffer(r[2]) for r in rows])
            p = x[:, :AMONG] @ axes.value[dim]
            p = np.pad(p, ((0, 0), (0, LEADING - p.shape[1])))
            made += 1
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([made - 1], pa.int32()), pa.array([label], kind), pa.array([dim], pa.int32()), pa.array([[r[3] for r in rows]], pa.list_(pa.binary())), pa.array([[r[4] for r in rows]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()])], names=["part", "seq", "label", "dim", "keys", "copies", "x", "lo", "hi"])

        for batch in batches:
            kind = batch.schema.field("label").type
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "unit", "key", "copies")), strict=True):
                if rest and (row[:2] != rest[0][:2] or len(rest) >= BLOCK):
                    yield block(rest)
                    rest = []
                rest.append(row)
        if rest:
            yield block(rest)

    return run


def _linked(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at or above ``cosine``, by recursion on halves; of one block with itself each pair once."""
    left, right = [], []

    def join(i0: int, i1: int, j0: int, j1: int) -> None:
        gap = np.maximum(0, np.maximum(pa_[i0:i1].min(axis=0) - pb[j0:j1].max(axis=0), pb[j0:j1].min(axis=0) - pa_[i0:i1].max(axis=0)))
        if gap @ gap > eps * eps * (1 + 1e-9) or (same and i0 >= j1):
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            s = a[i0:i1] @ b[j0:j1].T
            i, j = np.nonzero(s >= cosine - 1e-9)
            near = np.flatnonzero(s[i, j] < cosine + 1e-9)
            ok = np.ones(len(i), dtype=bool)
            for k in near:  # at the edge: exactly rounded sums decide
                ok[k] = math.fsum((a[i0 + i[k]] * b[j0 + j[k]]).tolist()) >= cosine
            i, j = i[ok] + i0, j[ok] + j0
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i), right.append(j)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            join(i0, m, j0, j1), join(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            join(i0, i1, j0, m), join(i0, i1, m, j1)

    join(0, len(a), 0, len(b))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def _joined(axes, cosine: float, eps: float):
    """For a pair of blocks: each linked node's links and the least node of its component within the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for k in range(batch.num_rows):
                get = lambda c, k=k, col=col: col[c][k].as_py()
                same, dim = get("a") == get("b"), get("dim")
                xa, xb = (np.frombuffer(get(c)).reshape(-1, dim) for c in ("xa", "xb"))
                p = [x[:, :AMONG] @ axes.value[dim] for x in (xa, xb)]
                i, j = _linked(xa, xb, *p, same, cosine, eps)
                if not len(i):
                    continue
                base_a, base_b = get("a") * BLOCK, get("b") * BLOCK
                u, v = i + base_a, j + base_b
                wa, wb = np.asarray(get("na")), np.asarray(get("nb"))
                nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
                links = np.bincount(at, np.concatenate((wb[j], wa[i])), minlength=len(nodes)).astype(np.int64)
                x, y, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
                while True:  # least node within these links
                    new = least.copy()
                    np.minimum.at(new, x, least[y])
                    np.minimum.at(new, y, least[x])
                    new = new[new]
                    if (new == least).all():
                        break
                    least = new
                yield pa.record_batch([pa.array(nodes), pa.array(links), pa.array(nodes[least])], names=["node", "links", "least"])

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * cosine)
    label_type = vectors.schema[label_col].dataType.simpleString()
    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_checked, f"id long, label {label_type}, key binary, unit binary, dim int"), "vectors")
    nodes = written(rows.where("key is not null").groupBy("label", "dim", "key").agg(F.count("*").alias("copies"), F.first("unit").alias("unit")), "nodes")
    axes = spark.sparkContext.broadcast(_axes(nodes))
    cells = [f"c{i}" for i in range(LEADING)]
    placed = nodes.mapInArrow(_placed(axes, eps), f"label {label_type}, dim int, key binary, copies long, unit binary, {', '.join(f'{c} int' for c in cells)}")
    order = ["label", "dim", *cells, "key"]
    blocks = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(axes), f"part int, seq int, label {label_type}, dim int, keys array<binary>, copies array<long>, x binary, lo array<double>, hi array<double>"), "blocks")
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offset = spark.createDataFrame(starts, "part int, start long")
    blocks = blocks.join(F.broadcast(offset), "part").withColumn("block", F.col("start") + F.col("seq"))

    # Intervals of the sequence: blocks, then FAN of them, and so on; each with its bounding box.
    box = [f"{side}{i}" for side in ("lo", "hi") for i in range(LEADING)]
    levels = [checkpointed(blocks.select("label", "dim", F.col("block").alias("node"), *(F.col(c[:2])[int(c[2:])].alias(c) for c in box)))]
    while FAN ** len(levels) < max(total, 1) * FAN:
        levels.append(levels[-1].withColumn("node", F.floor(F.col("node") / FAN)).groupBy("label", "dim", "node").agg(*((F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in box)))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}"))
    near = sum((gap(i) * gap(i) for i in range(LEADING)), F.lit(0.0)) <= eps * eps * (1 + 1e-9)
    pairs = None
    for level in reversed(levels):
        if pairs is None:  # the top level has one interval
            pairs = level.alias("x").join(level.alias("y"), ["label", "dim"]).where(F.col("x.node") <= F.col("y.node"))
        else:
            below = lambda side, level=level: level.withColumn("up", F.floor(F.col("node") / FAN)).withColumnRenamed("node", f"{side}_node")
            pairs = pairs.join(below("a").alias("x"), (F.col("p.label") == F.col("x.label")) & (F.col("p.dim") == F.col("x.dim")) & (F.col("p.a") == F.col("x.up"))).join(below("b").alias("y"), (F.col("p.label") == F.col("y.label")) & (F.col("p.dim") == F.col("y.dim")) & (F.col("p.b") == F.col("y.up"))).where("a_node <= b_node")
        top = level is levels[-1]
        a, b = ("x.node", "y.node") if top else ("a_node", "b_node")
        label = ["label", "dim"] if top else ["p.label", "p.dim"]
        pairs = pairs.where(near).select(*label, F.col(a).alias("a"), F.col(b).alias("b")).alias("p")
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("x").alias(f"x{s}"), F.col("copies").alias(f"n{s}"))
    both = pairs.select("a", "b", "dim").repartition("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim", "xa", "xb", "na", "nb")
    found = written(both.mapInArrow(_joined(axes, cosine, eps), "node long, links long, least long"), "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = blocks.select("label", "dim", (F.col("block") * BLOCK).alias("first"), F.posexplode(F.arrays_zip("keys", "copies")).alias("p", "z")).select("label", "dim", (F.col("first") + F.col("p")).alias("node"), F.col("z.keys").alias("key"), F.col("z.copies").alias("copies"))
    known = known.join(links, "node", "left").join(parts, "node", "left")
    known = known.select("label", "dim", "key", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = written(rows.drop("unit").join(known, ["label", "dim", "key"], "left"), "members")
    least = out.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    result = out.join(least, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    result = result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))
    for t in (rows, nodes, found):
        dropped(t)
    return result
