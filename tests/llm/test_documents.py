"""Operators on documents: against brute force, and on nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import licences, near_dedup, packing, quality, substring_dedup, suffix_tree, toxicity
from tessera.llm.decontamination import contaminated_windows, decontaminated

LONG = " ".join(f"w{i}" for i in range(6000))
BASE = " ".join(f"b{i}" for i in range(120))
ODD = [(1, BASE), (2, BASE), (2, BASE), (3, None), (2, "z " + BASE), (4, ""), (5, " \n\t "), (6, LONG), (7, BASE.replace("b60", "x")), (8, "a b"), (9, "a b"), (10, LONG + " tail"), (None, BASE), (11, "nichts\x00 é ß 日本語 a b")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Columns with the operators' own names in the way."""
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "kept", "starts", "key", "length", "rank", "held", "p_toxic", "digest", "score", "x")})
    return df.repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def removed(rows, size=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                keep[j : j + size] = [False] * size
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()]
    assert sorted(got, key=repr) == removed(rows)


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    import numpy as np

    assert substring_dedup.merged(np.array([3, 0, 60, 40]), 50) == [(0, 110)]


def test_near_duplicates(documents):
    rows = {r.doc_id: r.text.split() for r in documents.select("doc_id", "text").collect()}
    runs = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, w in rows.items() if w}
    cls = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents).collect()}
    assert set(cls) == set(rows)
    linked, ids = {i: {i} for i in rows}, sorted(runs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 0.8 <= len(rows[a]) / len(rows[b]) <= 1.25 or min(len(rows[a]), len(rows[b])) < 6:
                shared = sum((runs[a] & runs[b]).values())
                if shared >= 0.8 * (sum(runs[a].values()) + sum(runs[b].values()) - shared) - 1e-9:
                    linked[a].add(b), linked[b].add(a)
    changed, least = True, {i: i for i in rows}
    while changed:
        changed = False
        for i, others in linked.items():
            m = min(least[j] for j in others)
            if m < least[i]:
                least[i], changed = m, True
    assert cls == least


def test_near_duplicates_odd(odd, spark):
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=repr)
    want = [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 1, False), (8, 8, True), (9, 8, False), (10, 6, False), (11, 11, True), (None, 1, True)]
    assert got == sorted(want, key=repr)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_aligned_runs():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.aligned_runs(a, a, 0.8) == 100
    assert near_dedup.aligned_runs(a, np.roll(a, 5), 0.8) == 95
    assert near_dedup.aligned_runs(a, a[::-1].copy(), 0.8) <= 21
    assert near_dedup.aligned_runs(a, a + np.uint64(50), 0.8) == 0


def test_packing(documents, odd, spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    for text in ["don't we'LL  it's\n\nx <|endoftext|> ½ ² z_a 12ab", "", " lead", "tail ", "日本語 a\x1cb", "l'été ß"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    for df in (documents, odd):
        texts = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            texts[r.doc_id, len(ids), zlib.crc32(np.asarray(ids[: len(ids) % 2048 or 2048], "<u4").tobytes())] += 1
        pieces = packing.pack_sequences(df, path).collect()
        first = Counter()
        lengths = Counter()
        for p in pieces:
            lengths[p.doc_id] += p.length
            if p.piece == 0:
                first[p.doc_id, p.ids_crc32] += 1
        assert first == sum((Counter({(d, c): n}) for (d, _, c), n in texts.items()), Counter())
        assert lengths == sum((Counter({d: n * k}) for (d, n, _), k in texts.items()), Counter())
        by = {}
        for p in pieces:
            by.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by) <= math.ceil(sum(lengths.values()) / 2048) * 1.1 + 2
    assert packing.pack_sequences(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_plan():
    counts = {5: 3, 4: 2, 3: 5, 1: 1, 10: 2}
    plan = packing.packing_plan(counts, 10)
    assert all(sum(b) <= 10 for b, _ in plan)
    assert sum((Counter({n: c * k for n, c in Counter(b).items()}) for b, k in plan), Counter()) == Counter(counts)
    assert packing.packing_plan({}, 10) == []
    # 6 + 3 leaves a gap of 1 that two pieces fill in place of the 3
    assert [6, 2, 2] in [b for b, _ in packing.packing_plan({6: 1, 3: 1, 2: 2}, 10)]


def runs_of(text, k=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return w, k


def test_decontamination(documents, odd, spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated_windows(documents, bench).collect()}
    want = {}
    docs = [(r.doc_id, runs_of(r.text)[0]) for r in documents.select("doc_id", "text").collect()]
    for item in bench.collect():
        w = runs_of(item.text)[0]
        k = min(5, len(w))
        own = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        for i, x in docs:
            all_ = [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
            if any(r in own for r in all_):
                best = max(sum((Counter(all_[s : s + len(w) - k + 1]) & own).values()) / sum((Counter(all_[s : s + len(w) - k + 1]) | own).values()) for s in range(max(1, len(x) - len(w) + 1)))
                if best >= 0.8 - 1e-9:
                    want[i, item.item_id] = best
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    items = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20, 60))), (2, None), (3, ""), (4, "A b"), (5, "zzz")], "item_id long, text string")
    hit = {(r.doc_id, r.item_id) for r in contaminated_windows(odd, items).collect()}
    assert hit == {(1, 1), (2, 1), (7, 1), (8, 4), (9, 4), (11, 4)}
    assert None in [r.doc_id for r in decontaminated(odd, items).collect()]
    assert contaminated_windows(odd, items.where("false")).count() == 0
    assert contaminated_windows(odd.where("false"), items).count() == 0


def test_suffix_tree(documents, odd, spark):
    held = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        split = lambda t: [*(bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in words(t)), b"\n"]
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for i, t in rows if not out(i) for w in split(t))
        n, v = sum(c.values()), len(c)
        want = sorted(((i, out(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 5)) for i, t in rows), key=repr)
        res = suffix_tree.suffix_tree_scores(df, held).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in res), key=repr) == want
        assert all(r.score <= 1e-9 for r in res)
    assert suffix_tree.suffix_tree_scores(spark.createDataFrame([], SCHEMA), held).count() == 0


def suffix_scores(rows, out, depth=4, prior=1.0, divergence=2.0):
    """Scores by (id, text) of the whole tree, every context counted one by one."""
    split = lambda t: [*(bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in words(t)), b"\n"]
    texts = [(out(i), split(t)) for i, t in rows]
    c = Counter(w for held, ws in texts if not held for w in ws)
    base = sum(c.values()) + len(c) + 1
    n, seen = Counter(), Counter()
    for held, ws in texts:
        for k, x in enumerate(ws):
            for j in range(1, min(k, depth) + 1):
                n[tuple(ws[k - j : k])] += not held
                seen[tuple(ws[k - j : k]), x] += not held

    def chain(ws, k, own):
        p = [(c[ws[k]] + 1) / base]
        for j in range(1, min(k, depth) + 1):
            s = tuple(ws[k - j : k])
            p.append((seen[s, ws[k]] - own + prior * p[-1]) / (n[s] - own + prior))
        return p

    total = Counter()
    for held, ws in texts:
        for k in range(0 if held else len(ws)):
            p = chain(ws, k, 1)
            for j in range(1, len(p)):
                total[tuple(ws[k - j : k])] += math.log(p[j] / p[j - 1])
    scores = []
    for _, ws in texts:
        score = 0.0
        for k in range(len(ws)):
            p = chain(ws, k, 0)
            score += math.log10(p[max([0, *(j for j in range(1, len(p)) if total[tuple(ws[k - j : k])] >= divergence)])])
        scores.append(score)
    return sorted(((i, len(ws), round(x, 3)) for (i, _), (_, ws), x in zip(rows, texts, scores, strict=True)), key=repr)


@pytest.mark.parametrize("hot", [None, 3, 40])
@pytest.mark.parametrize("which", ["odd", "some"])
def test_suffix_tree_whole(request, spark, documents, which, hot):
    """Contexts that begin with any word, of any length, wherever they are counted, against brute force."""
    df = request.getfixturevalue("odd") if which == "odd" else documents.where("doc_id % 3 = 0").repartition(3)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = suffix_scores([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], out)
    res = suffix_tree.suffix_tree_scores(df, F.expr("crc32(cast(doc_id as string)) % 7 = 2"), hot=hot).collect()
    got = sorted(((r.doc_id, r.n_tokens, round(r.score, 3)) for r in res), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 0.003 for g, w in zip(got, want, strict=True))
    assert sum(r.score for r in res if r.held_out) > sum(r.base_score for r in res if r.held_out) or which == "odd"


def test_suffix_tree_frequent(spark):
    """A frequent word that decides what follows is a state, and so is a context across two of them."""
    rows = [(i, f"of{i % 2} the w{i % 2} z{i}") for i in range(200)]
    got = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 10 == 3).collect()}
    assert all(r.score > r.base_score + 1 for r in got.values())


def test_suffix_tree_states():
    """A word that always follows a rare one is predicted better, and states' distributions sum to one."""
    import numpy as np

    steps = np.array([(7, -3.0), (7, -3.0), (9, -2.0)], dtype=suffix_tree._STEP)
    gain = suffix_tree.context_gains(np.array([1, 1, 2]), np.array([False, False, False]), np.array([1, 1, 1]), steps, 4, 1.0, 2.0)
    assert abs(gain[0] - math.log10((2 + 1e-3) / 3 / 1e-3)) < 1e-6 and gain[2] == 0


def test_quality(documents, odd, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    got = quality.quality_scores(documents, labels, held, F.col("quality"))
    rows = got.join(labels, "doc_id").collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert sum(right) / len(right) > 0.9 and got.count() == documents.count()
    few = spark.createDataFrame([(1, 1), (6, None), (99, 0)], "doc_id long, quality int")
    out = quality.quality_scores(odd, few, held, F.col("quality")).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.quality_scores(odd.where("false"), few, held, F.col("quality")).count() == 0


def test_toxicity(odd, spark):
    clean = [(i, f"the calm text number{i} of words and more words") for i in range(60)]
    foul = [(100 + i, f"the calm idiot number{i} of scum and more words") for i in range(30)]
    docs = spark.createDataFrame(clean + foul, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    chain = toxicity.fit_chain(docs, labels, [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))])
    new = spark.createDataFrame([(1, "an unseen idiot and scum here"), (2, "an unseen calm text here"), (3, None), (4, "")], SCHEMA)
    p = {r.doc_id: r.p_toxic for r in toxicity.score(new, chain).collect()}
    assert p[1] > 0.8 and p[2] < 0.5 and p[3] == p[4] == 0
    out = toxicity.score(odd, chain)
    assert out.count() == len(ODD) and dict(out.dtypes)["p_toxic"] == "double"
    empty = toxicity.fit_chain(docs, labels.where("false"), [("toxic", F.col("toxic"))])
    assert all(r.p_toxic < 0.5 for r in toxicity.score(new, empty).collect())


def test_licences(odd, spark):
    from tessera.llm.licence_texts import MIT

    texts = [(1, MIT), (2, MIT.upper().replace(" ", "  ")), (3, "Copyright (c) 2020 X\n\n" + MIT), (4, MIT + " more"), (5, "x\nReleased under the MIT Licence.\ny"), (6, None), (7, "")]
    got = {r.doc_id: (r.license, r.notices) for r in licences.license_scan(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: ("MIT", ""), 4: (None, ""), 5: (None, "MIT"), 6: (None, ""), 7: (None, "")}
    assert licences.license_scan(odd).count() == len(ODD)


def test_licences_common(spark):
    """Common licences, notices without the word licence, and other spellings of a notice's first word."""
    from pathlib import Path

    from tessera.llm.licence_texts import TEXTS

    folder = Path(licences.__file__).parent / "licence_files"
    texts = [(f.stem, f"Copyright 2020 X\n{f.read_text().upper()}") for f in folder.glob("*.txt")] + [(k, TEXTS[k]) for k in ("BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    got = licences.license_scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert len(got) == 16 and all(r.license == r.doc_id for r in got)
    lines = [(1, "x\n// SPDX-License-Identifier: BSD-3-Clause"), (2, "Licenced under CC BY 4.0"), (3, "* Free to use by all *\ny"), (4, "Not free to use by all")]
    df = spark.createDataFrame(lines, SCHEMA)
    assert {r.doc_id: r.notices for r in licences.license_scan(df).collect()} == {1: "BSD-3-Clause tag", 2: "CC-BY-4.0", 3: "", 4: ""}
    assert {r.doc_id: r.notices for r in licences.license_scan(df, notices={"all": "Free to use by all."}).collect()} == {1: "", 2: "", 3: "all", 4: ""}
