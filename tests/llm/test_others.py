"""Embeddings, revisits, components, and the pipeline's stages."""

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm._shared import connected_components
from tessera.llm.embedding_dedup import embedding_duplicates
from tessera.llm.revisits import canonical_url, resolved_revisits


@pytest.mark.parametrize("name", ["op1_epsilon_grid_join", "op3_revisit_resolution", "op6_license_digests", "op10_substring_dedup"])
def test_rows(spark, duck, name):
    assert same_rows(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 60] + 0.03 * rng.normal(size=8)], i % 2) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, None, 0), (304, [0.0] * 8, 0), (305, [float("nan")] * 8, 0), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [], 0), (309, [None] * 8, 0), (300, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "key": F.lit("k"), "unit": F.lit(0)})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(df).collect())
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and label is not None for _, v, label in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                link[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    comp = np.array([r[0] for r in rows])
    for _ in range(n):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
    assert got == sorted((rows[i][0], int(link[i].sum()), int(comp[i])) for i in range(n))
    assert embedding_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == got[100] == 100
    assert connected_components(edges.where("false")).count() == 0


def test_revisits(spark):
    rows = [(1, "http://www.a.com/x/", 1, "response", {"ETag": '"1"', "Content-Length": "9", "Date": "d1"}), (2, "https://a.com/x?utm_source=q", 2, "revisit", {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0"}), (3, "https://a.com/x", 1, "revisit", {"ETag": '"1"'}), (4, "https://a.com/x", 3, "revisit", None), (5, None, 3, "revisit", {"ETag": '"1"'}), (6, "https://a.com/x", None, "revisit", {}), (7, "https://a.com/x", 9, "revisit", {"ETag": '"2"'}), (8, "https://a.com/x", 4, "request", {})]
    df = spark.createDataFrame(rows, "record_id long, url string, captured long, kind string, headers map<string,string>").withColumns({"id": F.lit(0), "part": F.lit(1), "key": F.lit("")})
    got = {r.record_id: (r.status, r.response_id, r.headers) for r in resolved_revisits(df).collect()}
    assert got[2] == ("resolved", 1, {"etag": 'W/"1"', "content-length": "9", "date": "d2"})
    assert {k: v[0] for k, v in got.items()} == {2: "resolved", 3: "no_earlier_response", 4: "no_validator", 5: "no_earlier_response", 6: "no_earlier_response", 7: "validator_mismatch"}
    assert resolved_revisits(df.where("false")).count() == 0
    assert spark.range(1).select(canonical_url(F.lit("HTTP://U@WWW.A.com:80/p//?ref=1&b=2#f"))).first()[0] == "a.com/p?b=2"


def test_pipeline(spark):
    """Each stage against its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    one = corpus_pipeline.one_of_each(spark, docs, DATA)
    assert one.columns == docs.columns and one.groupBy("text").count().where("count > 1").count() == 0
    cut = corpus_pipeline.without_repeats(spark, docs, DATA)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    clean = corpus_pipeline.without_benchmark(spark, docs, DATA)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert 0 < clean.count() < docs.count() and not any(i in r.text for r in clean.collect() for i in items)
    kept = corpus_pipeline.without_toxic(spark, docs, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").select("doc_id")
    assert kept.columns == docs.columns and kept.join(labels, "doc_id").count() >= 0.97 * docs.join(labels, "doc_id").count()
