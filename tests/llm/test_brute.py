"""The pipeline and operators that no SQL expresses, against plain versions; and what the methods' bounds promise."""

import math
import random
import shutil
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_dedup, quality, queries, revisits, toxicity
from tessera.llm.decontamination import contaminated_windows
from tessera.llm.licence_texts import ISC
from tessera.llm.licences import license_scan

BASE = " ".join(f"b{i}" for i in range(120))
CLASHING = ("key", "kept", "class_id", "text_hash", "id", "starts", "item", "p_toxic", "length", "node")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The documents of the smallest tables, and rows with repeated and null ids, null, empty and repeated texts, and
    columns with the operators' own names."""
    base = tmp_path_factory.mktemp("small")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", base)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kind = docs.schema
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    odd = [(1000, BASE), (1001, "u " + BASE), (1001, " ".join(f"c{i}" for i in range(80))), (1002, "once more"), (1002, "once more"), (1003, None), (1004, ""), (None, BASE), (None, item), (1005, f"{item} and"), (1005, "clean words of one id"), (1006, " ".join(f"q{i}" for i in range(200)) + " " + " ".join(f"d{i}" for i in range(60))), (1007, " ".join(f"r{i}" for i in range(150)) + " " + " ".join(f"d{i}" for i in range(60)))]
    rows = [(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd]
    all_ = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(f.name).cast(f.dataType) for f in kind)))
    all_.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).write.parquet(f"{base}/documents.parquet")
    return str(base)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_run(spark, small):
    """Each stage on what its predecessor kept, and run() as their chain."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]

    def staged(name, given):
        path = f"{small}/{name}"
        stages[name](spark, given, small).write.parquet(path)
        return spark.read.parquet(path)

    labels = spark.read.parquet(f"{small}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))])

    def toxic(text):
        own, p = brute.features(text, chain.bits), []
        for w, v in zip(chain.weights, chain.links, strict=True):
            p.append(1 / (1 + math.exp(-max(-30, min(30, sum(w[c] for c in own) + v[0] + sum(a * b for a, b in zip(v[1:], p, strict=True)))))))
        return bool(own) and p[-1] >= queries.TOXIC_AT

    clean = staged("toxicity", docs)
    assert clean.columns == docs.columns
    assert pairs(clean) == Counter({k: n for k, n in pairs(docs).items() if not toxic(k[1])})
    assert clean.count() < docs.count()

    one = staged("near_dedup", clean)
    given = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    whole = [r for r in dict.fromkeys(given) if r[0] is not None and brute.words(r[1])]
    groups = {}
    for row, g in zip(whole, brute.near_groups(whole), strict=True):
        groups.setdefault(g, []).append(row)
    want = Counter({r: n for r, n in Counter(given).items() if r[0] is None}) + Counter(r for r in set(given) if r[0] is not None and not brute.words(r[1]))
    got = pairs(one)
    assert one.columns == docs.columns and all(got[r] == n for r, n in want.items())
    kept = got - want
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert all([r[0] for r in rows if r in kept] == [min(r[0] for r in rows)] for rows in groups.values())
    assert got[(1001, " ".join(f"c{i}" for i in range(80)))] == 1 and got[(1001, "u " + BASE)] == 0 and got[(1002, "once more")] == 1

    cut = staged("substring_dedup", one)
    given = [(r.doc_id, r.text) for r in one.select("doc_id", "text").collect()]
    want = Counter((i, t if len(w) == len(brute.words(t)) else b" ".join(w).decode()) for (i, t), w in zip(given, brute.kept_words(given), strict=True))
    assert cut.columns == docs.columns and pairs(cut) == want != Counter(given)
    changed = cut.join(one.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old and length(text) <> n_chars")
    assert changed.where("doc_id >= 1006").count() == 0

    free = staged("decontamination", cut)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = Counter({(i, t): n for (i, t), n in pairs(cut).items() if i is None or not brute.holds_item(t, items)})
    assert pairs(free) == want and (1005, "clean words of one id") in want and cut.count() > free.count()

    packed = staged("packing", free)
    assert_packed(packed, [(r.doc_id, r.text) for r in free.select("doc_id", "text").collect()])
    same = lambda df: sorted((tuple(map(str, (r.doc_id, r.piece, r.start, r.length, r.ids_crc32))) for r in df.collect()), key=repr)
    assert same(pipeline.run(spark, small)) == same(packed)


def assert_packed(pieces, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want, filled = Counter(), {}
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, n, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    got = pieces.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(filled) <= math.ceil(sum(r.length for r in got) / 2048) * 1.1 + 2


def test_stages_empty(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name


def test_quality_recomputed(spark):
    """Moments, shrunk covariances, Mahalanobis differences and calibration once more in NumPy."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels, held, F.col("quality")).collect()}
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    x = {i: quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for i, t in rows}
    learned = [(x[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    d, by = len(quality.STATISTICS), [np.array([v for v, y in learned if y == c]) for c in (0, 1)]
    spread = [np.cov(b.T, bias=True) for b in by]
    n = [len(b) for b in by]
    mixed = lambda s: 0.95 * s + 0.05 * np.diag(np.diag(s))
    pooled = mixed((n[0] * spread[0] + n[1] * spread[1]) / sum(n)) + 1e-6 * np.eye(d)
    cov = [(1 - a) * mixed(s) + a * pooled for s, k in zip(spread, n, strict=True) for a in [max(0.2, min(1.0, 3.0 * (d + 1) / k))]]

    def difference(v):
        density = [-0.5 * ((v - b.mean(axis=0)) @ np.linalg.solve(c, v - b.mean(axis=0)) + np.linalg.slogdet(c)[1]) for b, c in zip(by, cov, strict=True)]
        return density[1] - density[0]

    z = [np.clip([difference(v) for v in b], -60, 60) for b in by]
    slope = max(z[1].mean() - z[0].mean(), 1e-6) / max(0.5 * (z[0].var() + z[1].var()), 1.0)
    s = [v.std() + 1e-3 for v in z]
    middle = (z[0].mean() * s[1] + z[1].mean() * s[0]) / (s[0] + s[1])
    for i, v in x.items():
        assert abs(got[i] - 1 / (1 + math.exp(-max(-35, min(35, slope * (difference(v) - middle)))))) < 1e-5


def test_toxicity_recomputed(spark):
    """Held-out labels, the chain's scores once more, and null and repeated labels and documents."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    named = [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]
    chain = toxicity.fit_chain(docs, labels.where(~out), named)
    got = toxicity.score(docs, chain).join(labels.where(out), "doc_id").select("text", "p_low_quality", "p_toxic", "toxic").collect()
    foul, fine = ([r.p_toxic for r in got if r.toxic == y] for y in (1, 0))
    assert sum(p >= queries.TOXIC_AT for p in foul) >= 0.8 * len(foul) and sum(p < queries.TOXIC_AT for p in fine) >= 0.98 * len(fine)
    for r in got[:60]:
        own = brute.features(r.text, chain.bits)
        first = 1 / (1 + math.exp(-np.clip(sum(chain.weights[0][c] for c in own) + chain.links[0][0], -30, 30)))
        second = 1 / (1 + math.exp(-np.clip(sum(chain.weights[1][c] for c in own) + chain.links[1][0] + first * chain.links[1][1], -30, 30)))
        assert abs(r.p_low_quality - (first if own else 0)) < 1e-9 and abs(r.p_toxic - (second if own else 0)) < 1e-9
    few = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(1, "foul"), (1, "fine"), (2, "x"), (None, "y"), (9, None)], "doc_id long, text string")
    assert toxicity.score(texts, toxicity.fit_chain(texts, few, named)).count() == 5


def test_index_switched_off(spark):
    """The blocks find what comparing every window with every item of its size finds, with far fewer comparisons."""
    docs, items = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(contaminated_windows(docs, items)) == rows(contaminated_windows(docs, items, radius=64, blocks=64))
    near = lambda width, flips: sum(math.comb(width, n) for n in range(flips + 1)) / 2**width
    widths = [64 * (b + 1) // 6 - 64 * b // 6 for b in range(6)]
    assert 1 - math.prod(1 - near(w, 17 // 6) for w in widths) < 0.25
    assert sum(math.comb(64, n) for n in range(18)) / 2**64 < 3e-4


@pytest.mark.parametrize("n", [3, 100, 32767, 32769, 70000])
def test_simhash_counters(spark, n):
    """Sign bits of many hashes: 16-bit counters would overflow beyond 32,767 of them."""
    runs = [(i * 0x9E3779B97F4A7C15 ^ 0x5555 | 1) % (1 << 64) for i in range(n)]
    signed = [r - (1 << 64) if r >= 1 << 63 else r for r in runs]
    got = decontamination._with_simhash(spark.createDataFrame([(signed,)], "runs array<long>"), "runs", "h").first().h % (1 << 64)
    counts = [int(c) for c in ((np.array(runs, dtype=np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)]
    assert got == sum(1 << b for b, c in enumerate(counts) if 2 * c > n)


def edited(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_recall(spark):
    """Groups of edited copies with similarities around the threshold, one of them crowded, against all pairs."""
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(rng.choice((9, 14, 30, 90, 160)))]
        for _ in range(120 if g == 0 else 12):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice((0, 0.01, 0.02, 0.03, 0.05))))))
    rng.shuffle(rows)
    want = dict(zip((i for i, _ in rows), brute.near_classes(rows), strict=True))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) < len(rows) / 2
    assert sum(got[i] == c for i, c in want.items()) >= 0.99 * len(rows)
    assert all(want[i] <= c for i, c in got.items())  # nothing is linked that isn't near


def test_near_sketch_recall():
    """Pairs of just the threshold meet in one sketch at least."""
    rng = np.random.default_rng(3)
    seeds = near_dedup.mixed(np.arange(1, 81, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def keys(runs):
        own = near_dedup._sketch(runs, seeds[:40], 6)
        return {*own.tolist(), *(near_dedup._sketch(runs, seeds[40:], 3).tolist() if len(runs) <= 24 else ())}

    met = tried = 0
    for n in (4, 8, 12, 24, 40, 200):  # shared runs; each text has n / 8 of its own
        for _ in range(150):
            runs = rng.integers(1, 2**63, size=n + n // 4, dtype=np.uint64)
            a, b = np.delete(runs, slice(n, n + n // 8)), np.delete(runs, slice(n + n // 8, None))
            met, tried = met + bool(keys(a) & keys(b)), tried + 1
    assert met >= 0.99 * tried


def test_revisit_keys(spark):
    at = {"dns:a.com": "dns:a.com", "dns:b.org": "dns:b.org", "urn:x:1": "urn:x:1", "a.com/x": "a.com/x", "HTTPS://www.A.com:443/x/?refpage=2": "a.com/x?refpage=2", "http://a.com/x?page=2#f": "a.com/x?page=2", "http://a.com/?a=1&refresh=1": "a.com?a=1&refresh=1", "http://a.com/?ref=1&utm_x&a=1&ref": "a.com?a=1", "ftp://a.com/x": "ftp://a.com/x", "//a.com/x": "a.com/x", "DNS:a.com#f": "dns:a.com"}
    got = spark.createDataFrame([(u,) for u in at], "u string").select("u", revisits.canonical_url(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == at
    tag = {"etag": '"1"'}
    rows = [(1, "dns:a.com", 1, "response", tag), (2, "dns:b.org", 2, "revisit", tag), (3, "http://a.com/", 1, "response", {"etag": '"0"'}), (4, "https://a.com", 1, "response", tag), (5, "http://a.com", 2, "revisit", tag), (5, "http://a.com", 2, "revisit", tag), (6, "http://a.com", 3, "revisit", {"ETag": '"9"', "etag": '"1"'})]
    df = spark.createDataFrame(rows, "record_id long, url string, captured long, kind string, headers map<string,string>")
    out = sorted((r.record_id, r.status, r.response_id or 0) for r in revisits.resolved_revisits(df).collect())
    assert out == [(2, "no_earlier_response", 0), (5, "resolved", 4), (5, "resolved", 4), (6, "resolved", 4)]


def test_licences_wrapped(spark):
    """Lines of a licence's prose that begin with copyright stay; those that state a holder or a year go."""
    wrapped = ISC.replace("provided that the above copyright", "provided that the above\ncopyright")
    assert "\ncopyright notice" in wrapped
    rows = [(1, wrapped), (2, "Copyright (c) 2020, Jane Doe\n(c) 2021 X\n© Y\nCopyright: The Authors\n" + wrapped), (3, "Copyright notice\n" + ISC), (4, "(c) You must\n" + ISC)]
    got = {r.doc_id: r.license for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ISC", 2: "ISC", 3: None, 4: None}
