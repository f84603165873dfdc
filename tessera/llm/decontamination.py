"""Benchmark decontamination with SimHash over item-sized windows; DataFrame functions only.

Every benchmark item is compared with the windows of as many words as it has. A window can only reach the similarity if
it shares a run of ``k`` words with the item, and sliding a window right to its first shared run loses none, so the
windows that start at a shared run (or end with the document) hold the best one: only these are fingerprinted. Each
fingerprint is the sign vector of the summed bits of its word runs. Multi-index blocks then find candidates: the 64
bits are cut into ``blocks`` blocks, and fingerprints within ``radius`` bits agree in one block up to
``radius // blocks`` bits, so the items list all such variants of each block and windows look theirs up. Candidates
within the radius are verified exactly: the sum of the lesser run weights by that of the greater ones, with a run's
weight its count.

The default radius is 17 of 64 bits: texts that share 8/9 of their run weight, which a similarity of 0.8 has, differ in
each bit with probability 0.15, so in 10 bits on average, and in more than 17 in 3 of 1000 pairs; more similar ones
hardly ever. Random fingerprints are that near with 2e-4. With 6 blocks of 10 or 11 bits one block agrees to within two
bits, which 18 % of random pairs do.

Defined cases: words are runs of letters and digits in lower case; null or empty texts and items match nothing; items
under k words use runs of their own length; documents shorter than an item are one window; repeated ids are merged;
null ids match nothing; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Benchmarks of more runs than this are joined by a shuffle and not sent to every executor.
BROADCAST_RUNS = 2_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, k: int) -> Column:
    """Hashes of the k-word runs, one for each start. The words are bound to a lambda variable, so that no optimiser
    rule copies their expression into the inner one, where it would run again for every start."""

    def of(w: Column) -> Column:
        return F.when(F.size(w) < k, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))

    return F.element_at(F.transform(F.array(words), of), 1)


def _with_simhash(df: DataFrame, runs: str, name: str) -> DataFrame:
    """Adds 64 sign bits of the summed bits of an array of hashes. Four 16-bit counters share a long, or two 32-bit ones
    where an array has more entries than 15 bits count (the upper counter ends in the sign)."""

    ones = {w: sum(1 << b for b in range(0, 64, w)) for w in (16, 32)}
    of = lambda values: f"if(w = 16, {values[16]}L, {values[32]}L)"
    lanes = f"transform(sequence(0, w - 1), b -> aggregate({runs}, 0L, (a, r) -> a + (shiftrightunsigned(r, b) & {of(ones)})))"
    count = f"shiftrightunsigned(l[b % w], cast(b DIV w AS INT) * w) & {of({w: (1 << w) - 1 for w in (16, 32)})}"
    bits = f"aggregate(sequence(0, 63), 0L, (s, b) -> s | if(2 * ({count}) > size({runs}), shiftleft(1L, b), 0L))"
    return df.withColumn(name, F.expr(f"element_at(transform(array(if(size({runs}) < 32768, 16, 32)), w -> element_at(transform(array({lanes}), l -> {bits}), 1)), 1)"))


def _variants(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 17, blocks: int = 6) -> DataFrame:
    """(id, item, start, n_words, similarity): for each document and item the first best window at or above the similarity."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(item_text_col).cast("string")).alias("iw")).where("item is not null and size(iw) > 0").distinct()
    items = items.select("item", "iw", F.size("iw").alias("n"), F.least(F.size("iw"), F.lit(k)).alias("k"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most k rows
    found = None
    for size in sizes:
        own = items.where(F.col("k") == size).select("item", "n", _runs(F.col("iw"), size).alias("item_runs"))
        part = _matches(source, own, size, similarity, radius, blocks)
        found = part if found is None else found.union(part)
    if found is None:
        found = source.join(items, F.lit(False)).select("id", "item", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words"))
    return found.groupBy("id", "item").agg(best.alias("b")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _matches(source: DataFrame, items: DataFrame, k: int, similarity: float, radius: int, blocks: int) -> DataFrame:
    per_run = items.select("n", F.explode(F.array_distinct("item_runs")).alias("run")).groupBy("run").agg(F.collect_set("n").alias("ns"))
    if items.agg(F.sum(F.size("item_runs"))).first()[0] <= BROADCAST_RUNS:
        per_run = F.broadcast(per_run)
    runs = _runs(_words(F.col("text")), k).alias("runs")
    seeds = source.select("id", runs).select("id", F.posexplode_outer("runs").alias("p", "run")).join(per_run, "run").select("id", "p", F.explode("ns").alias("n"))
    starts = seeds.groupBy("id").agg(F.collect_set(F.struct("n", "p")).alias("at"))  # bounded by the document's own length
    placed = source.join(starts, "id").select("id", runs, "at").select("id", "runs", F.explode("at").alias("at")).select("id", F.col("at.n").alias("n"), F.expr(f"greatest(0, least(at.p, size(runs) - (at.n - {k - 1})))").alias("start"), "runs")
    windows = placed.select("id", "n", "start", F.expr(f"slice(runs, start + 1, n - {k - 1})").alias("win")).dropDuplicates(["id", "n", "start", "win"])  # rows that share an id may differ
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    flips = radius // blocks  # of the bits of one block at least, if all differ in the radius
    block = lambda c, b: F.shiftrightunsigned(c, cuts[b]).bitwiseAND(F.lit((1 << (cuts[b + 1] - cuts[b])) - 1))
    windows = _with_simhash(windows, "win", "wh")
    marked = _with_simhash(items, "item_runs", "ih")
    near = F.array(*(F.array(*map(F.lit, _variants(cuts[b + 1] - cuts[b], flips))) for b in range(blocks)))
    index = marked.select("item", "n", "ih", F.posexplode(F.array(*(block(F.col("ih"), b) for b in range(blocks)))).alias("b", "v"), near.alias("near"))
    index = index.select("item", "n", "ih", "b", "v", F.explode(F.get("near", F.col("b"))).alias("flip")).select("item", "n", "ih", "b", F.col("v").bitwiseXOR(F.col("flip").cast("long")).alias("v"))
    probes = windows.select("id", "n", "start", "win", "wh", F.posexplode(F.array(*(block(F.col("wh"), b) for b in range(blocks)))).alias("b", "v"))
    # A pair is taken in the first of its agreeing blocks only.
    apart = F.col("wh").bitwiseXOR(F.col("ih"))
    first = F.array_position(F.array(*(F.bit_count(block(apart, b)) <= flips for b in range(blocks))), True) - 1
    near = probes.join(index, ["n", "b", "v"]).where((F.bit_count(apart) <= radius) & (first == F.col("b")))
    near = near.select("id", "n", "start", "win", "item").join(items.select("item", "n", "item_runs"), ["item", "n"])
    count = "cast(size(filter({0}, y -> y = x)) as double)"
    shared = F.expr(f"aggregate(array_intersect(win, item_runs), 0D, (a, x) -> a + least({count.format('win')}, {count.format('item_runs')}))")
    scored = near.withColumn("shared", shared).withColumn("similarity", F.expr("shared / (size(win) + size(item_runs) - shared)"))
    return scored.where(F.col("similarity") >= similarity - 1e-9).select("id", "item", "start", F.col("n").alias("n_words"), "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item; rows with a null id stay."""
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")))
    hit = contaminated_windows(docs.select(key.alias("key"), text_col), benchmark, "key", text_col, **options)
    hit = hit.select(F.col("key.id").alias("_hit_id"), F.col("key.hash").alias("_hit_hash")).distinct()
    return docs.join(hit, (F.col(id_col) == F.col("_hit_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_hit_hash")), "left_anti").select(docs.columns)
