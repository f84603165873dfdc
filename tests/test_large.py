"""Inputs on which queries failed or differed once they were larger: small tables of the same kind, and their plans."""

import duckdb
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import incremental as I
from tessera.operators import scan as S
from tessera.plans import registry, scans

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def odd_pages(spark, tmp_path):
    """Titles and articles that end within an entity, and two pages of one address."""
    words = "word &amp;&amp; &lt;x&gt; &quot;y&quot; &#39;z&#39; &amp;lt; " * 4
    made = [(i, f"https://e.edu/{i % 20}", f"<title>T{i}&amp;{end}</title><article>{words}{end}</article><p>&copy; after") for i, end in enumerate(["&amp", "&am", "&a", "&quo", "&lt;", "&copy", ""] * 6)]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["article_text", "diff_sources", "title_text"])
def test_odd_pages(spark, odd_pages, name):
    place, con = odd_pages
    assert same_rows(QUERIES[name](spark, place), con, SQL[name])


def test_changed_by_two_columns(spark):
    now = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "c")], "id int, url string, h string")
    old = now.where("id < 3").withColumn("h", F.when(F.col("id") == 1, "x").otherwise(F.col("h")))
    assert I.changed(now, old, ["id", "url"], "h").collect() == [(1, "u")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unresolved(spark):
    """All kinds of places against the list of what exists, and by sorted joins alone."""
    claims = spark.createDataFrame([(1, "/fees/0/value"), (2, ""), (3, None), (None, "/fees/0/value"), (4, "programmes//1/name/")], "scan_id int, claim_path string")
    paths = ["", "/", "//", "/fees", "fees/0", "/fees/0/value/", "/fees/0/other", "/admissions", "/programmes/1", "/programmes/1/name", "/run", "/odd", None]
    evidence = spark.createDataFrame([(s, p) for s in (1, 2, 3, 4, 5, None) for p in paths], "scan_id int, claim_path string")
    known = {(r[0], r[1]) for r in E.resolvable_paths(claims).collect()}
    clean = lambda p: None if p is None else "/" + "/".join(x for x in p.split("/") if x)
    want = [(s, p) for s, p in evidence.collect() if s is None or p is None or (s, clean(p)) not in known]
    found = E.unresolved(evidence, claims)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "Broadcast" not in plan(found)


def test_claim_paths_sent_to_nobody(spark):
    assert "Broadcast" not in plan(QUERIES["claim_paths_resolve"](spark, DATA))


def test_pages_followed_sent_to_nobody(spark):
    assert "Broadcast" not in plan(QUERIES["pagination_walk"](spark, DATA))


def test_scans_log(spark):
    """The log with events worked out once for pages that scans share is that of each page by itself."""
    columns = ["scan_id", "page_order", "url", "k", "field", "extractor", "status", "reason", "record_count", "found"]
    want = S.attempts(scans.sites(spark, DATA).where("scan_id < 4")).select(columns).collect()
    assert len(want) > 100
    assert sorted(scans.log(spark, DATA).where("scan_id < 4").select(columns).collect(), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["scan_attempts", "scan_claims"])
def test_scans_go_once(spark, name):
    """Scans are dealt out once, and the extractor in Python runs before pages meet scans, below a broadcast."""
    lines = plan(QUERIES[name](spark, DATA)).split("== Initial Plan ==")[-1]
    assert lines.count("Exchange hashpartitioning") == 1
    assert lines.index("BroadcastExchange") < lines.index("ArrowEvalPython")
