"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z in lower case) and one end token a text. The root's distribution is the add-one one over all
training tokens. Below it the tree holds contexts of 1 to ``depth`` words. Each has the counts of what follows it in the
training texts, smoothed with ``prior`` pseudo-counts of the next shorter suffix's distribution, so each sums to one. A
context is retained if it diverges from the next shorter suffix: the log ratios of its training occurrences, each left
out of the counts of both, must sum to ``divergence`` nats or more. Every token is scored by the longest retained
suffix of the words before it in its text, else by the root. Contexts with one training occurrence sum to 0 and are not
counted; ``divergence`` and ``prior`` have to be above 0.

Slices of texts are encoded once and written to the shared folder. Counts of each slice's distinct words are summed by a
64-bit hash and go back to the slices with a number for each word. All suffixes before a token end with the same word, so
the token travels once, with the words before it, to the task of that word. Words with more than ``hot`` training
occurrences (by default a task's share) don't meet in one task: what follows them is counted by (context, next word) from
each slice's distinct pairs, and their tokens travel by the shortest suffix that isn't hot. That decides where a context
is counted, never whether. Buckets are dealt out in two turns, so that half of the tokens are in shuffle files at a time.

Defined cases: null, empty and white-space texts are the end token alone; null ids belong to the training texts;
repeated rows count each; with no training text the base has N = V = 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Words, dropped, mixed, text_slices, written

_BITS = 22  # of a text's place in its slice
_WORDS = 1 << 20  # of a slice, about
_SHARE = 1 << 19  # tokens of a bucket, about
_TURNS = 2  # in which the buckets are dealt out, so that only a part of the tokens is in shuffle files at a time
_STEP = np.dtype([("x", "<u4"), ("log", "<f8")])  # a token: its word and its root log10 probability
_START = np.dtype([("p", "<f4"), ("q", "<f4"), ("gain", "<f4")])  # where hot suffixes leave a token; p and q in root's


def _packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes."""
    raw = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T)
    return len(raw).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: str | np.dtype) -> np.ndarray:
    n, kind = int.from_bytes(blob[:4], "little"), np.dtype(kind)
    raw = pa.decompress(blob[4:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted 64-bit hashes begins; one more entry at the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows with the same value; they come sorted, and the last ones are kept for the next batch."""
    rest: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
            if rest and rest[0][column] != row[column]:
                yield rest
                rest = []
            rest.append(row)
    if rest:
        yield rest


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_SLICE = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("docs", pa.int64()), ("words", pa.int64()), ("all", pa.int64()), ("places", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_SLICES = "slice long, ids array<long>, held array<boolean>, n array<int>, docs long, words long, all long, places binary, keys binary, counts binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice: ids and lengths of texts, the words by place, and each distinct word once."""
    part, made = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        if made >= 1 << 16:  # numbers of a partition's slices have 16 bits, those of its texts _BITS
            raise ValueError("a partition has too many slices: repartition the documents")
        out, n = np.concatenate(held), np.concatenate(sizes)
        keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(place, np.repeat(~out, n), minlength=len(keys))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
        cells = [pa.array([(part << 16) + made]), one(pa.concat_arrays(ids), pa.int64()), one(out, pa.bool_()), one(n, pa.int32()), pa.array([int((~out).sum())]), pa.array([int(n[~out].sum())]), pa.array([int(n.sum())]), *(pa.array([x], pa.binary()) for x in (_packed(place.astype("<u4")), keys.tobytes(), _packed(count.astype("<u4"))))]
        for x in (ids, held, sizes, hashes):
            x.clear()
        return pa.record_batch(cells, schema=_SLICE)

    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            words = Words(data, offsets, lower=True)
            ids.append(rows.column(0))
            held.append(rows.column(2).to_numpy(zero_copy_only=False).astype(bool))
            sizes.append(words.counts())
            hashes.append(words.hashes())
            if sum(map(len, hashes)) >= _WORDS or sum(map(len, ids)) >= 1 << (_BITS - 1):
                yield row()
                made += 1
    if ids:
        yield row()


_ASK = pa.schema([("p", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKS = "p int, slice long, keys binary, counts binary"
_ANSWER = pa.schema([("slice", pa.int64()), ("p", pa.int32()), ("c", pa.binary()), ("word", pa.binary()), ("types", pa.int64()), ("most", pa.int64())])
_ANSWERS = "slice long, p int, c binary, word binary, types long, most long"


def _asks(slice_id: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    cuts = _cuts(keys, buckets)
    return _rows([{"p": p, "slice": slice_id, "keys": keys[a:b].tobytes(), "counts": _packed(counts[a:b].astype("<u4"))} for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], _ASK)


def _word_asks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _asks(row["slice"], np.frombuffer(row["keys"], "<u8"), _unpacked(row["counts"], "<u4"), buckets)

    return run


def _answers(buckets: int):
    """The sum of each key's counts, and a number for the key, from 1 on, small for frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "p"):
            keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
            own, place = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(place, np.concatenate([_unpacked(r["counts"], "<u4") for r in rows])).astype("<u8")
            rank = np.empty(len(own), "<u8")
            rank[np.argsort(-c.astype(np.int64), kind="stable")] = np.arange(len(own))
            word = (rank * np.uint64(buckets) + np.uint64(rows[0]["p"] + 1)).astype("<u4")
            at = np.cumsum([0, *map(len, keys)])
            yield _rows([{"slice": r["slice"], "p": r["p"], "c": _packed(c[place[a:b]]), "word": _packed(word[place[a:b]]), "types": int((c > 0).sum()) if not k else 0, "most": int(c.max())} for k, (r, a, b) in enumerate(zip(rows, at[:-1], at[1:], strict=True))], _ANSWER)

    return run


def _answered(asks: DataFrame, buckets: int, name: str) -> DataFrame:
    return written(asks.repartition("p").sortWithinPartitions("p").mapInArrow(_answers(buckets), _ANSWERS), name)


def _listed(answers: DataFrame, name: str) -> DataFrame:
    """All answers to a slice; bounded by the slice."""
    return answers.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("p", "c", "word"))).alias(name))


class _Tokens:
    """A slice's tokens and what is known of the suffixes before them after some rounds of answers on hot ones."""

    def __init__(self, row: dict, rounds: int, ends: int, root: Callable, depth: int, hot: int, prior: float):
        whole = lambda name, field, kind: np.concatenate([np.zeros(0, kind), *(_unpacked(x[field], kind) for x in row[name] or [])])
        self.n = np.asarray(row["n"], np.int64)
        self.held = np.asarray(row["held"], bool)
        place = _unpacked(row["places"], "<u4")
        self.owner = np.repeat(np.arange(len(self.n)), self.n + 1)
        last = np.cumsum(self.n + 1) - 1
        inner = np.ones(len(self.owner), bool)
        inner[last] = False
        self.c = np.full(len(inner), ends, np.int64)
        self.c[inner] = whole("words", "c", "<u8")[place]
        self.x = np.zeros(len(inner), np.uint32)  # the end token is 0
        self.x[inner] = whole("words", "word", "<u4")[place]
        self.root = root(self.c)
        self.train = ~self.held[self.owner]
        # the number of words before each token, at most depth, up to one that has fewer than 2 training occurrences
        first = np.zeros(len(inner), np.int64)
        first[last[:-1] + 1] = last[:-1] + 1
        low = np.flatnonzero(inner & (self.c < 2))
        first[low + 1] = low + 1  # the end token comes after every word
        at = np.arange(len(inner))
        self.size = np.minimum(at - np.maximum.accumulate(first), depth)
        self.p, self.q, self.gain = self.root.copy(), self.root.copy(), np.zeros(len(inner))
        self.level = np.zeros(len(inner), np.int64)  # hot suffixes passed
        self.hot: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.wanted = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        rows = np.flatnonzero(self.size > 0)
        self.state = np.zeros(len(inner), np.uint64)
        self.state[rows] = mixed(self.x[rows - 1].astype(np.uint64) + np.uint64(1))
        rows = rows[self.c[rows - 1] > hot]
        n_s = self.c[rows - 1]
        for j in range(1, depth + 1):
            # rows: tokens after a hot suffix of j words that has n_s training occurrences
            longer = self.size[rows] > j
            follow = mixed(self.state[rows] + np.uint64(0x9E3779B97F4A7C15) * (self.x[rows].astype(np.uint64) + np.uint64(1)))
            deeper = rows[longer]
            state = _longer(self.state[deeper], self.x[deeper - j - 1])
            keys, place = np.unique(np.concatenate([follow, mixed(state ^ np.uint64(0xA5A5A5A5))]), return_inverse=True)
            self.wanted = keys, np.bincount(place, self.train[np.concatenate([rows, deeper])], minlength=len(keys)).astype(np.int64)
            if j > rounds or not len(rows):
                break
            got = whole(f"hot{j}", "c", "<u8").astype(np.int64)[place]
            n_x, n_longer = got[: len(rows)], got[len(rows) :]
            t = self.train[rows].astype(np.int64)
            q = np.where(t > 0, (n_x - t + prior * self.q[rows]) / (n_s - t + prior), self.q[rows])
            p = (n_x + prior * self.p[rows]) / (n_s + prior)
            self.hot.append((rows, self.state[rows], np.where(t > 0, np.log(q / self.q[rows]), 0.0), np.log10(p / self.root[rows])))
            self.p[rows], self.q[rows], self.level[rows] = p, q, j
            self.state[deeper] = state
            self.size[deeper[n_longer < 2]] = j
            rows, n_s = deeper[n_longer > hot], n_longer[n_longer > hot]

    def keep(self, retained: np.ndarray) -> None:
        """Gains of the longest retained hot suffixes."""
        for rows, state, _, gain in self.hot:
            kept = np.isin(state, retained)
            self.gain[rows[kept]] = gain[kept]


def _longer(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(state * np.uint64(0xD6E8FEB86659FD93) + word.astype(np.uint64) + np.uint64(1))


def context_gains(context: np.ndarray, held: np.ndarray, sizes: np.ndarray, steps: np.ndarray, depth: int, prior: float, divergence: float, older: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """What the longest retained suffix adds to each token's root log10 probability.

    ``context`` is the token's shortest suffix that is counted here, and all tokens after it are given; the next longer
    ones add the words of ``older`` one by one, and there are ``sizes`` of them in all. ``start``: see _START."""
    x, root = steps["x"].astype(np.uint64), 10.0 ** steps["log"].astype(float)
    p, q, gain = root.copy(), root.copy(), np.zeros(len(context))
    if start is not None:
        p, q, gain = root * start["p"], root * start["q"], start["gain"].astype(float)
    state = mixed(context.astype(np.uint64))
    rows = np.flatnonzero(sizes > 0)
    for j in range(depth):
        rows = rows[sizes[rows] > j]
        if not len(rows):
            break
        if j:
            state[rows] = _longer(state[rows], older[rows, j - 1])
        t = (~held[rows]).astype(np.int64)
        _, s = np.unique(state[rows], return_inverse=True)
        n_s = np.bincount(s, t)[s].astype(np.int64)
        some = n_s >= 2  # others, and all that are longer, sum to 0
        rows, t, s, n_s = rows[some], t[some], s[some], n_s[some]
        if not len(rows):
            break
        _, g = np.unique(mixed(state[rows] + np.uint64(0x9E3779B97F4A7C15) * (x[rows] + np.uint64(1))), return_inverse=True)
        n_g = np.bincount(g, t)[g]
        left = np.where(t > 0, (n_g - t + prior * q[rows]) / (n_s - t + prior), q[rows])
        total = np.bincount(s, np.where(t > 0, np.log(left / q[rows]), 0.0))
        q[rows], p[rows] = left, (n_g + prior * p[rows]) / (n_s + prior)
        kept = rows[total[s] >= divergence]
        gain[kept] = np.log10(p[kept] / root[kept])
    return gain


_PIECE = pa.schema([("p", pa.int32()), ("slice", pa.int64()), *((k, pa.binary()) for k in ("before", "x", "c", "meta", "text", "start"))])
_PIECES = "p int, slice long, before binary, x binary, c binary, meta binary, text binary, start binary"
_GAIN = pa.schema([("slice", pa.int64()), ("text", pa.binary()), ("gain", pa.binary())])


def _pieces(t: _Tokens, slice_id: int, buckets: int, depth: int, turn: int) -> Iterator[pa.RecordBatch]:
    """The tokens whose suffixes are not all known yet, by the hash of their shortest such suffix; those of a turn's
    buckets."""
    rows = np.flatnonzero(t.size > t.level)
    rows = rows[((t.state[rows] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) % np.uint64(_TURNS) == turn]
    rows = rows[np.argsort(t.state[rows])]
    cuts = _cuts(t.state[rows], buckets)
    for p in np.flatnonzero(np.diff(cuts)):
        r = rows[cuts[p] : cuts[p + 1]]
        r = r[np.argsort(t.x[r - 1], kind="stable")]
        size, level = t.size[r], t.level[r]
        before = [np.where(size > k, t.x[r - np.minimum(k, size - 1) - 1], 0).astype("<u4") for k in range(depth)]
        before[0] = np.diff(before[0], prepend=np.uint32(0))
        h = r[level > 0]
        start = np.empty(len(h), _START)
        start["p"], start["q"], start["gain"] = t.p[h] / t.root[h], t.q[h] / t.root[h], t.gain[h]
        _, one = np.unique(t.x[r], return_index=True)
        meta = (size * (depth + 1) + level) * 2 + ~t.train[r]
        yield _rows([{"p": int(p), "slice": slice_id, "before": _packed(np.concatenate(before)), "x": _packed(t.x[r]), "c": _packed(t.c[r[one]].astype("<u8")), "meta": _packed(meta.astype("<u4")), "text": _packed(t.owner[r].astype("<u4")), "start": _packed(start)}], _PIECE)


def _gains(root: Callable, depth: int, prior: float, divergence: float):
    """Of each task's buckets: what their suffixes add to each slice's texts."""

    def bucket(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = [_unpacked(r["x"], "<u4") for r in rows]
        at, steps = np.cumsum([0, *map(len, x)]), np.empty(sum(map(len, x)), _STEP)
        steps["x"] = np.concatenate(x)
        steps["log"] = np.concatenate([np.log10(root(_unpacked(r["c"], "<u8").astype(np.int64)))[np.unique(y, return_inverse=True)[1]] for r, y in zip(rows, x, strict=True)])
        meta = np.concatenate([_unpacked(r["meta"], "<u4") for r in rows]).astype(np.int64)
        size, level = np.divmod(meta >> 1, depth + 1)
        before = np.concatenate([_unpacked(r["before"], "<u4").reshape(depth, -1) for r in rows], axis=1)
        for a, b in zip(at[:-1], at[1:], strict=True):
            before[0, a:b] = np.cumsum(before[0, a:b], dtype=np.uint32)
        context = mixed(before[0].astype(np.uint64) + np.uint64(1))
        older = np.zeros((len(x := steps["x"]), depth), np.uint32)
        older[:, : depth - 1] = before[1:].T
        start = np.ones(len(x), _START)
        start["gain"] = 0
        start[level > 0] = np.concatenate([_unpacked(r["start"], _START) for r in rows])
        for j in range(1, depth):
            passed = np.flatnonzero(level >= j)
            context[passed] = _longer(context[passed], older[passed, 0])
            older[passed, :-1] = older[passed, 1:]
        gain = context_gains(context, meta & 1 > 0, size - level, steps, depth, prior, divergence, older, start)
        for r, a, b in zip(rows, at[:-1], at[1:], strict=True):
            yield r["slice"], _unpacked(r["text"], "<u4"), gain[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            some = {k: np.flatnonzero(v) for k, v in sums.items()}
            out = _rows([{"slice": k, "text": _packed(np.diff(i, prepend=0).astype("<u4")), "gain": _packed(sums[k][i])} for k, i in some.items() if len(i)], _GAIN)
            sums.clear()
            return out

        for rows in _by(batches, "p"):
            for k, text, gain in bucket(rows):
                new = np.bincount(text, gain)
                old = sums.get(k, new[:0])
                if len(old) > len(new):
                    old, new = new, old
                new[: len(old)] += old
                sums[k] = new
            if sum(map(len, sums.values())) > _SHARE:
                yield given()
        yield given()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by(batches, "slice"):
        sums = np.bincount(np.concatenate([np.cumsum(_unpacked(r["text"], "<u4"), dtype=np.int64) for r in rows]), np.concatenate([_unpacked(r["gain"], "<f8") for r in rows]))
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array((rows[0]["slice"] << _BITS) + some), pa.array(sums[some])], names=["text", "gain"])


def _each(tokens: Callable, made: Callable):
    """``made`` of each slice's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from made(tokens(row), row)

    return run


def suffix_tree_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, prior: float = 1.0, divergence: float = 2.0, hot: int | None = None) -> DataFrame:
    """Per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). ``held_out``: a boolean column."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    slices = written(source.mapInArrow(_encoded, _SLICES), "slices")
    totals = slices.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "words", "all"))).first()
    ends, tokens = totals["docs"], totals["words"] + totals["docs"]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), totals["all"] // _SHARE)
    hot = max(totals["all"] // buckets, 1) if hot is None else hot
    answers = _answered(slices.select("slice", "keys", "counts").mapInArrow(_word_asks(buckets), _ASKS), buckets, "answers")
    seen = answers.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.max("most"), F.lit(0)).alias("most")).first()
    base = written(slices.select("slice", "ids", "held", "n", "places").join(_listed(answers, "words"), "slice", "left"), "base")
    dropped(slices)
    dropped(answers)
    over = tokens + seen["types"] + (ends > 0) + 1.0
    root = lambda c: (c + 1.0) / over
    rounds, most = 0, seen["most"]
    known = lambda r: lambda row: _Tokens(row, r, ends, root, depth, hot, prior)
    while most > hot and rounds < depth:
        ask = lambda t, row: [_asks(row["slice"], *t.wanted, buckets)] if len(t.wanted[0]) else []
        got = _answered(base.mapInArrow(_each(known(rounds), ask), _ASKS), buckets, "hot")
        most = got.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
        rounds += 1
        last, base = base, written(base.join(_listed(got, f"hot{rounds}"), "slice", "left"), "base")
        dropped(last)
        dropped(got)
    retained = np.zeros(0, np.uint64)
    if rounds:

        def parts(t: _Tokens, row: dict) -> Iterator[pa.RecordBatch]:
            for _, state, ratio, _ in t.hot:
                keys, place = np.unique(state, return_inverse=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(place, ratio, minlength=len(keys)))], names=["state", "ratio"])

        sums = base.mapInArrow(_each(known(rounds), parts), "state long, ratio double").groupBy("state").agg(F.sum("ratio").alias("ratio")).where(F.col("ratio") >= divergence)
        retained = np.array([r.state for r in sums.select("state").collect()], np.int64).view(np.uint64)  # at most depth * tokens / hot

    def texts(t: _Tokens, row: dict) -> Iterator[pa.RecordBatch]:
        t.keep(retained)
        size = len(t.n)
        add = lambda values: pa.array(np.bincount(t.owner, values, minlength=size))
        done = np.where(t.size > t.level, 0.0, t.gain)
        yield pa.record_batch([pa.array((row["slice"] << _BITS) + np.arange(size)), pa.array(row["ids"], pa.int64()), pa.array(t.held), pa.array(t.n + 1), pa.array(np.bincount(t.owner, t.c > 0, minlength=size).astype(np.int64)), add(np.log10(t.root)), add(done)], names=["text", "id", "held", "n_tokens", "n_known", "base", "done"])

    def pieces(turn: int) -> Callable:
        def made(t: _Tokens, row: dict) -> Iterator[pa.RecordBatch]:
            t.keep(retained)
            yield from _pieces(t, row["slice"], buckets, depth, turn)

        return made

    scored = written(base.mapInArrow(_each(known(rounds), texts), "text long, id long, held boolean, n_tokens long, n_known long, base double, done double"), "scored")
    gains = None
    for turn in range(_TURNS):
        dealt = base.mapInArrow(_each(known(rounds), pieces(turn)), _PIECES).repartition("p").sortWithinPartitions("p")
        part = written(dealt.mapInArrow(_gains(root, depth, prior, divergence), "slice long, text binary, gain binary"), "gains")
        gains = part if gains is None else gains.union(part)
    dropped(base)
    gains = gains.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed, "text long, gain double")
    out = scored.join(gains, "text", "left")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("done") + F.coalesce("gain", F.lit(0.0))).alias("score"))
