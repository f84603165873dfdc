"""A scan of a folder from pages to files, what the command line refuses, and rules on values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import english, extract
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import crawl
from tessera.sources import captured


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    (root / "admissions/undergraduate").mkdir(parents=True)
    page = lambda title, body, links=(): f"<title>{title}</title><main>{body}{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</main>"
    (root / "index.html").write_text(page("Undergraduate Admissions", "Undergraduate admissions. How to apply. Application period: 1 October 2026 to 15 January 2027. " + "Welcome to all. " * 5, ["admissions/undergraduate/fees.html", "admissions/undergraduate/programmes.html", "/missing.html", "https://other.org/x"]))
    (root / "admissions/undergraduate/fees.html").write_text(page("Tuition Fees", "Undergraduate tuition fees are SGD 32000 per year for international students. " + "Read on. " * 10))
    (root / "admissions/undergraduate/programmes.html").write_text(page("Undergraduate Programmes", "<p>Undergraduate programmes .</p><table><tr><td>Law</td><td>Bachelor of Laws</td></tr><tr><td>Arts</td><td>Bachelor of Arts</td></tr></table><p>; " + "Read on. " * 10))
    return str(root)


def test_scan_to_files(spark, site, tmp_path):
    before = tmp_path / "before.json"
    before.write_text(json.dumps({"sources": [{"source_url": "https://fixture.test/", "content_hash": "old"}]}))
    out = str(tmp_path / "out")
    assert cli.main([site, "--fixture", "--output-dir", out, "--previous-result", str(before)]) == 0
    claims = {r.claim_path: r.value for r in spark.read.parquet(f"{out}/tables/claims").collect()}
    assert claims["/admissions/application_periods/0/value"] == "1 October 2026 to 15 January 2027"
    assert claims["/fees/0/value"].startswith("tuition fees are SGD 32000 per year")
    assert {v for k, v in claims.items() if k.startswith("/programmes/") and k.endswith("/name")} == {"Bachelor of Laws", "Bachelor of Arts"}
    body = "\n".join(r.value for r in spark.read.text(f"{out}/report.md", wholetext=True).collect())
    assert body.index("## Core Field Coverage") < body.index("## Facts") < body.index("## Evidence appendix") and "`source_changed` https://fixture.test/" in body
    rows = spark.read.option("header", True).csv(f"{out}/programme_catalog.csv").collect()
    assert [(r.programme_id, r.name, r.degree_or_award) for r in sorted(rows)] and {r.name for r in rows} == {"Law", "Arts"}
    result = json.loads(spark.read.text(f"{out}/result.json").first().value)
    assert len(result["sources"]) == 3 and result["coverage"]["found"] == 4


@pytest.mark.parametrize("argv", [[], ["x"], ["x", "--fixture", "--enable-browser"], ["x", "--fixture", "--no-llm", "--enable-llm"], ["x", "--fixture", "--llm-provider", "mock"], ["x", "--fixture", "--enable-source-planning"], ["x", "--fixture", "--enable-llm"], ["x", "--fixture", "--enable-scrapegraph"], ["x", "--fixture", "--relevance-strategy", "bm25-like"]])
def test_refused(argv):
    with pytest.raises(SystemExit) as e:
        cli.checked(argv)
    assert e.value.code == 2


def test_smoke_limits():
    a = cli.checked(["x", "--fixture", "--smoke", "--max-pages", "50", "--max-depth", "1"])
    assert (a.max_pages, a.max_depth) == (20, 1) and cli.checked(["x", "--fixture"]).max_depth == 3


def test_site_requests(spark, site):
    base = "https://fixture.test/"
    pages = captured.read_site(spark, site, base)
    asked = ["https://fixture.test", "https://fixture.test/?q=1#f", "https://fixture.test/admissions/../index.html", "https://fixture.test/../../etc/passwd", "https://other.org/x", "https://fixture.test/admissions", "file:///etc/passwd"]
    got = {r.url: (r.status, r.title, r.warnings) for r in captured.fetched_from(pages, spark.createDataFrame([(u,) for u in asked], "url string"), base).collect()}
    assert [got[u][0] for u in asked] == [200, 200, 200, 404, 404, 404, 404]
    assert got[asked[1]][1] == "Undergraduate Admissions" and got[asked[3]][2] == ["fetch_failed"]


def test_joined_urls(spark):
    base = "https://h.edu/a/b.html?q=1#f"
    for link, want in {"x": "https://h.edu/a/x", "../x/./y": "https://h.edu/x/y", "/r/../s?z": "https://h.edu/s?z", "?k=2": "https://h.edu/a/b.html?k=2", "#t": "https://h.edu/a/b.html?q=1#t", "//o.edu/p": "https://o.edu/p", "": base, "../../..": "https://h.edu/", "http://o.edu/": "http://o.edu/"}.items():
        assert one(spark, U.joined(F.col("l"), F.lit(base)), l=link) == want, link
    assert one(spark, U.canonical_url(F.col("l"), F.lit(base)), l="../C/?utm_x=1&b=2&a=1") == "https://h.edu/C?a=1&b=2"
    assert one(spark, U.canonical_url(F.col("l")), l="FILE:///a/b?c#d") == "file:///a/b"
    allowed = lambda u, **o: one(spark, U.is_allowed(F.col("u"), "www.e.edu", "e.edu", **o), u=u)
    assert allowed("https://x.e.edu/") and not allowed("https://x.e.edu/", subdomains=False) and not allowed("file:///a") and allowed("file:///a", hosts=["file"])


def test_entities_and_noise(spark):
    assert one(spark, T.unescaped(F.col("t")), t="a&eacute;b&#8217;c &amp;lt; &notit; &copy &#x80; &unknown;") == "aéb’c &lt; ¬it; © € &unknown;"
    nested = "<div class='nav'><div class='menu'><div class='share'>x</div></div></div>" * 4 + "<div id='a'>keep</div>"
    assert "keep" in one(spark, T.without_noise(F.col("t")), t=nested) and "x" not in one(spark, T.without_noise(F.col("t")), t=nested).replace("<div id='a'>", "")


def test_money_rows(spark):
    text = "Left Column Local students HKD 47,000 Middle Column Non-local STEM (2026-27 cohort) HK$249,000.50 per annum AY 2026-27 | Application fee US$50. Tuition $5 in Singapore"
    got = one(spark, extract.money(F.col("t")), t=text)
    assert [(m.currency, m.amount, m.student_group, m.cohort, m.academic_year, m.billing_period, m.fee_type) for m in got] == [
        ("HKD", 47000, "local", None, None, None, "fee"),
        ("HKD", 249000, "non-local STEM", "2026-27 cohort", "2026/27", "per annum", "fee"),
        ("USD", 50, None, None, None, None, "application_fee"),
        ("SGD", 5, None, None, None, None, "tuition"),
    ]


def test_english_examples():
    got = english.tests_in("Applicants must obtain an overall band of 7 in the IELTS, with no subtest below 6.5.")
    assert [(t["test_name"], t["overall_score"], t["component_scores"]) for t in got] == [("IELTS", "7", {"minimum_component": "6.5"})]
    polyu = "Programme Entrance Requirements and Subject Weightings JUPAS Score Calculator English and Applied Linguistics - BA (Hons) Bachelor of Science Bachelor of Business Select a Programme Quick Links General University Requirements."
    assert english._requirement(polyu) is None and english._requirement(None) is None and english.tests_in("") == []


def test_pdf_limits(spark):
    lines = [("a", i, line) for i, line in enumerate(["x", "PDF PAGE 2", "y", "---PAGE 5---", "z"])] + [("b", 0, " ")]
    df = spark.createDataFrame(lines, "source string, position int, line string")
    pages, warnings = crawl.pdf_pages(df, 2)
    assert sorted((r.source, r.page, r.body) for r in pages.collect()) == [("a", 1, "x"), ("a", 2, "y")]
    assert sorted((r.source, r.code) for r in warnings.collect()) == [("a", "pdf_unavailable"), ("b", "pdf_parse_failed")]
    assert crawl.pdf_unavailable(df.select("source").distinct()).count() == 2


def test_best_first_whole(spark):
    """Every site's visits against a plain search that sorts what is queued before each step."""
    from conftest import DATA
    from pyspark.sql.window import Window

    o = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_custkey AS scan_id", "o_orderkey AS n", "CAST(o_orderkey % 13 AS INT) AS score")
    around = Window.partitionBy("scan_id").orderBy("n")
    links = F.array_compact(F.array(F.lead("n", 1).over(around), F.lead("n", 3).over(around), F.lag("n", 2).over(around), F.lit(-1)))
    pages = o.select("scan_id", F.col("n").cast("string").alias("url"), "score", F.transform(links, lambda x: x.cast("string")).alias("links"))
    seeds = pages.groupBy("scan_id").agg(F.min("url").alias("seed"))
    got = {}
    for r in crawl.best_first(pages, seeds, 6, 3).orderBy("scan_id", "page_order").collect():
        got.setdefault(r.scan_id, []).append((r.url, r.depth, r.status))
    sites = {}
    for r in pages.collect():
        sites.setdefault(r.scan_id, {})[r.url] = (r.score, r.links)
    for s in seeds.collect():
        site = sites[s.scan_id]
        queue, known, out = [(0, 0, s.seed)], {s.seed}, []  # (order, depth, url)
        while queue and len(out) < 6:
            queue.sort(key=lambda q: (-site.get(q[2], (0, []))[0], q[1], q[0]))
            _, depth, url = queue.pop(0)
            if depth > 3:
                continue
            out.append((url, depth, 200 if url in site else 404))
            for link in site.get(url, (0, []))[1]:
                if link not in known:
                    known.add(link)
                    queue.append((len(known), depth + 1, link))
        assert got[s.scan_id] == out
