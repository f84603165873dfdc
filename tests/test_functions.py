from pyspark.sql import functions as F

from tessera.functions import extract as X
from tessera.functions import gates as G
from tessera.functions import relevance as V
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import crawl as C
from tessera.sources import captured, sinks
from tessera.streaming import feed


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_canonical_url(spark):
    for url, want in {
        "HTTPS://User@Example.EDU:443/a/b/?utm_source=x&b=2&a=1#top": "https://example.edu/a/b?a=1&b=2",
        "//example.edu": "https://example.edu/",
        "http://e.edu:8080/x;p=1?q=a%20b": "http://e.edu:8080/x?q=a+b",
        "http://e.edu/?fbclid=1": "http://e.edu/",
    }.items():
        assert one(spark, U.canonical_url(F.col("u")), u=url) == want


def test_domains(spark):
    for host, want in {"a.b.example.edu.sg": "example.edu.sg", "www.example.org": "example.org", "localhost": "localhost", "a..b.c": "b.c"}.items():
        assert one(spark, U.registrable_domain(F.col("h")), h=host) == want


def test_challenge_and_context(spark):
    assert one(spark, G.is_challenge(F.lit("https://e.edu"), F.lit(None).cast("string"), F.col("t")), t="Access Denied")
    assert one(spark, G.undergraduate_context(F.lit("https://e.edu/postgraduate"), F.lit("Undergraduate admissions"), F.col("t")), t="") is False
    assert one(spark, G.undergraduate_context(F.lit("https://e.edu/study/ug"), F.lit(None).cast("string"), F.col("t")), t="") is True


def test_extractors(spark):
    d = one(spark, X.deadline(F.col("t")), t="Application window: 1 March 2027 to 2 April 2027, 5 pm. Deadline: 9 May 2027")
    assert (d.open_date, d.deadline) == ("1 March 2027", "2 April 2027, 5 pm")
    assert one(spark, X.deadline(F.col("t")), t="nothing") is None
    m = one(spark, X.money(F.col("t")), t="Tuition S$45,000.50 per annum for international STEM | Local: $9")
    assert [(x.currency, x.amount, x.student_group, x.billing_period) for x in m] == [("SGD", 45000, "non-local STEM", "per annum"), ("unknown", 9, "local", None)]
    assert one(spark, X.programme_names(F.col("t")), t="BSc in Physics must apply. bsc in physics. BA of Art") == ["BSc in Physics", "BA of Art"]
    assert one(spark, X.contact(F.lit("https://e.edu/privacy"), F.lit("x"), F.col("t")), t="a@b.edu") is None


def test_html_text(spark):
    html = "<nav>menu</nav><main><p>" + "word " * 30 + "&amp; more</p><div class='share'>x</div><table><tr><td>a</td><td>b</td></tr></table></main>"
    text = one(spark, T.html_text(F.col("h")), h=html)
    assert "menu" not in text and "& more" in text and "a | b" in text and " x " not in text


def test_keyword_plan():
    plan = V.keyword_plan("Fees, fees  undergraduate")
    assert plan.positive == ("fees", "undergraduate") and plan.url_hints == ("/fees", "/undergraduate", "/ug")
    assert V.keyword_plan("").warnings


def test_best_first(spark):
    pages = spark.createDataFrame([(1, "s", 0, ["a", "b"]), (1, "a", 1, ["c"]), (1, "b", 9, ["a", "z"]), (1, "c", 50, [])], "scan_id long, url string, score int, links array<string>")
    out = C.best_first(pages, spark.createDataFrame([(1, "s")], "scan_id long, seed string"), 4, 3).orderBy("page_order").collect()
    assert [(r.url, r.depth, r.status) for r in out] == [("s", 0, 200), ("b", 1, 200), ("a", 1, 200), ("c", 2, 200)]


def test_site_and_sinks(spark, tmp_path):
    (tmp_path / "site/apply.example.org").mkdir(parents=True)
    (tmp_path / "site/index.html").write_text("<title>Home</title><a href='/x'>x</a>")
    (tmp_path / "site/apply.example.org/a.json").write_text("{}")
    rows = {r.url: r for r in captured.read_site(spark, str(tmp_path / "site"), "https://e.edu/").collect()}
    assert rows["https://e.edu/"].title == "Home" and rows["https://e.edu/"].links == ["/x"]
    assert rows["https://apply.example.org/a.json"].source_type == "json"
    df = captured.read_site(spark, str(tmp_path / "site"), "https://e.edu/").withColumnRenamed("url", "source_url")
    sinks.write_sources(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_configs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"universities": [{"name": "A B!", "seed_url": "https://a"}, {"id": "x", "name": "X", "seeds": ["https://b", "https://c"], "max_pages": 3}]}')
    rows = captured.read_configs(spark, str(tmp_path / "c.json")).collect()
    assert [(r.id, r.seed_urls, r.max_pages) for r in rows] == [("a-b", ["https://a"], None), ("x", ["https://b", "https://c"], 3)]
    assert captured.read_previous(spark, str(tmp_path / "none.json")) is None


def test_fetchers(spark):
    out = captured.fetched(spark.createDataFrame([("https://e",)], "url string"), captured.UnavailableFetcher("browser")).first()
    assert out.status == 0 and out.warnings == ["optional_dependency_missing"]


def test_stream_matches_batch(spark, tmp_path):
    from conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = feed.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == feed.event_windows(events).count()
