"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Spark tokenises (Arrow batches) and counts how many pieces have each length. The packing itself needs only that
histogram, which has at most ``capacity`` rows at any corpus size: a plan fills a bin greedily with the longest piece
that fits, then swaps the bin's smallest piece for the two unpacked pieces that fill its gap more tightly, and applies
the finished pattern as often as the counts allow. Pieces find their slot by their rank among the pieces of their
length, from per-partition ranks and prefix sums, so that no group of equal lengths meets in one task.

Defined cases: a null or empty text is the end id alone; only documents longer than ``capacity`` are cut, the first
piece may be shorter; repeated rows are packed each; a null id is returned as null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import text_slices, written

#: Texts of these characters only, without special-token strings, take the word cache below; all others the library.
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
#: How byte-level BPE vocabularies of this family split a text; on plain texts ``[^\W\d_]`` is a letter and ``\d`` a digit.
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CACHED_WORDS = 500_000
_MARKS = tuple(".,;:!?")
#: White space other than single blanks and single line ends between words.
_LOOSE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")


def _as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.asarray(ids, dtype="<u4").tobytes()


class _Pieces(dict):
    """Token ids of a split part, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = _as_bytes(self.encode(part))
        if len(self) < CACHED_WORDS:
            self[part] = ids
        return ids


class _Spaced(dict):
    """Ids of a word between single white space: its split parts don't depend on its neighbours."""

    def __init__(self, parts: _Pieces, lead: str):
        super().__init__()
        self.parts, self.lead = parts, lead

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one part
            ids = _as_bytes(self.parts.encode(self.lead + word))
        elif word[-1:] in _MARKS and word[:-1].isalpha():  # a word and a mark are two parts
            ids = self[word[:-1]] + self.parts[word[-1]]
        else:
            ids = b"".join(map(self.parts.__getitem__, _SPLIT.findall(self.lead + word)))
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


def _byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable in
    Latin-1, else the next free one from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merging_by_rank(model: dict):
    """An encoder of single split parts where ids are the order of merges, else None."""
    import tiktoken

    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocab, symbols = model["vocab"], _byte_symbols()
    ids = [vocab[s] for s in [*symbols, *merges] if s in vocab]
    if len(ids) != 256 + len(merges) or ids[256:] != list(range(256, 256 + len(merges))) or set(ids[:256]) != set(range(256)):
        return None
    ranks = {bytes(symbols[c] for c in token): vocab[token] for token in [*symbols, *merges]}
    return tiktoken.Encoding("parts", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    The pre-tokeniser of the file decides whether split parts may be encoded one by one; if it isn't byte-level BPE with
    the usual pattern, every text goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_part = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"].get("type") == "BPE"
        by_rank = _merging_by_rank(spec["model"]) if self.by_part else None
        self.parts = _Pieces(by_rank or (lambda part: self.tokenizer.encode(part, add_special_tokens=False).ids))
        self.first, self.later = _Spaced(self.parts, ""), _Spaced(self.parts, " ")

    def __call__(self, text: str) -> bytes:
        if self.by_part and _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _LOOSE):
                return b"".join(map(self.parts.__getitem__, _SPLIT.findall(text)))
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self.first[first] + b"".join(map(self.later.__getitem__, rest)))
            return self.parts["\n"].join(lines)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _tokenised(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ranks, part = Encoder(path), Counter(), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for rows, _, _ in text_slices(batch):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                ids = rows.column(0).to_pylist()
                for doc, text in zip(ids, rows.column(1).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for col, value in zip(out, (doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), ranks[b - a]), strict=True):
                            col.append(value)
                        ranks[b - a] += 1
                n = len(out[0])
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:]), pa.array([part] * n, pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    return run


def _two_that_fit(lengths: list[int], left: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """Of the unpacked lengths the two whose sum is largest, at most ``room`` and above ``over``."""
    best, found = over, None
    lo, hi = 0, bisect_right(lengths, room) - 1
    while lo <= hi:
        x, y = lengths[lo], lengths[hi]
        if x + y > room or (lo == hi and left[x] < 2):
            hi -= 1
            continue
        if x + y > best:
            best, found = x + y, (y, x)
            if best == room:
                break
        lo += 1
    return found


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on a histogram of lengths: (lengths in a bin, number of such bins), every piece exactly once."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []

    def take(n: int, times: int) -> None:
        left[n] -= times
        if not left[n]:
            del left[n]
            lengths.remove(n)

    while lengths:
        bin_, room = [], capacity
        while (at := bisect_right(lengths, room)) > 0:
            n = lengths[at - 1]
            bin_.append(n)
            room -= n
            take(n, 1)
        while room:  # swap the smallest for two that fit its expanded gap more tightly, while that gains
            small = bin_[-1]
            pair = _two_that_fit(lengths, left, room + small, small)
            if pair is None:
                break
            bin_.pop()
            if small not in left:
                lengths.insert(bisect_right(lengths, small), small)
            left[small] = left.get(small, 0) + 1
            for n in pair:
                take(n, 1)
            bin_ = sorted([*bin_, *pair], reverse=True)
            room = capacity - sum(bin_)
        times = 1 + min((left.get(n, 0) // c for n, c in Counter(bin_).items()), default=0)
        if times > 1:
            for n, c in Counter(bin_).items():
                take(n, c * (times - 1))
        plan.append((bin_, times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a bin, first sequence, offset, bins): where the pieces of a length go,
    by rank. Its size follows the number of distinct lengths, not the corpus."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for n, c in sorted(Counter(bin_).items(), reverse=True):
            out.append((n, used[n], used[n] + c * times, c, sequence, offset, times))
            used[n] += c * times
            offset += n * c
        sequence += times
    return out


def pack_sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(source.mapInArrow(_tokenised(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int"), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.max("rank").alias("n")).select("length", "part", (F.col("n") + 1).alias("n"))
    before = per_part.select("length", "part", F.expr("coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(packing_plan(counts, capacity))
    where = spark.createDataFrame(table, "length long, lo long, hi long, copies long, sequence long, at long, bins long")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # ``where`` is bounded by the distinct lengths, so it may be sent to every executor.
    put = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (ranked["rank"] >= where["lo"]) & (ranked["rank"] < where["hi"])).drop(where["length"])
    k = F.col("rank") - F.col("lo")
    return put.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (k % F.col("copies"))).cast("long").alias("offset"))
