"""Queries over captured responses, API bodies, candidates and assisted facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import gates as G
from tessera.functions import relevance as V
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import captures as P
from tessera.operators import evidence as E
from tessera.plans.base import PAGES_SQL, case, derived_pages, query, sql_path, table, text


#: Responses by line: URL, content type, method, stated length and body, and what is kept of each.
_RESPONSES = (
    ("'https://e.edu/x?api_key=k' || l_partkey || '&q=v' || l_partkey || '&q=w'", "application/json; charset=utf-8", "get", None, "{}"),
    ("'https://e.edu/api/p?Access-Token=1&q=' || repeat('x', 300)", "text/html", "GET", "17", "<p>"),
    ("'https://e.edu/about?q=1'", "text/json", "GET", None, "{}"),
    ("'https://e.edu/odata/P'", "application/ld+json", "POST", None, "{}"),
    ("'https://e.edu/data.JSON'", "application/json", "GET", "2000001", "{}"),
    ("'https://e.edu/graphql?page=2'", "APPLICATION/JSON", "GET", "x", ""),
)


@query(
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'api_key=[redacted]; q=w' WHEN 1 THEN 'Access-Token=[redacted]; q=' || repeat('x', 157) || '...' WHEN 5 THEN 'page=2' ELSE '' END AS params, "
    "CASE WHEN l_linenumber % 6 = 1 THEN 'content-length=17; ' WHEN l_linenumber % 6 = 4 THEN 'content-length=2000001; ' WHEN l_linenumber % 6 = 5 THEN 'content-length=x; ' ELSE '' END || 'content-type=' || CASE l_linenumber % 6 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 3 THEN 'application/ld+json' WHEN 4 THEN 'application/json' WHEN 5 THEN 'APPLICATION/JSON' END || '; x-total-count=9' AS headers, "
    "CASE WHEN l_linenumber % 6 = 0 THEN '{}' END AS body, CASE l_linenumber % 6 WHEN 0 THEN 2 WHEN 1 THEN 17 WHEN 4 THEN 2000001 END AS size, l_linenumber % 6 = 4 AS truncated FROM lineitem WHERE l_linenumber % 6 <> 2"
)
def network_redaction(spark, sf_dir):
    pick = lambda n: case("l_linenumber", *("'" + r[n] + "'" if r[n] is not None else "CAST(NULL AS STRING)" for r in _RESPONSES))
    headers = f"map_filter(map('content-type', {pick(1)}, 'Set-Cookie', 'c', 'content-language', 'en', 'X-Total-Count', '9', 'Content-Length', {pick(3)}), (k, v) -> v IS NOT NULL)"
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", case("l_linenumber", *(r[0] for r in _RESPONSES)) + " AS url", f"{pick(2)} AS method", "200 AS status", f"{headers} AS headers", f"{pick(4)} AS body")
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    out = P.captured_responses(d)
    return out.select("l_orderkey", "l_linenumber", shown(F.col("query")).alias("params"), shown(F.col("headers")).alias("headers"), "body", "size", "truncated")


#: Pages by kind, with the number of links, and what the shell and block detectors say.
_SHELLS = (
    ("<div id=\"root\"></div><script></script>", 0),
    ("<p>plain</p>", 0),
    ("<script>a</script><script>b</script><script>c</script><script>d</script>hi", 1),
    ("Please enable JavaScript <script></script>", 1),
    ("<p>noindex, nofollow</p>", 2),
    ("<meta name=\"robots\" content=\"noindex, nofollow\">", 0),
    ("<div id=\"nuxt\"></div>", 2),
    ("<div id=\"__nuxt\"></div>", 0),
    ("<script>window.__INITIAL_STATE__</script>", 0),
    ("<script>webpackJsonp</script>", 1),
    ("You need JavaScript", 0),
    ("Access Denied", 0),
)
_SHELL_HTML = case("page_id", *("'" + html + "'" for html, _ in _SHELLS))
_SHELL_LINKS = case("page_id", *(str(n) for _, n in _SHELLS))


@query("SELECT page_id, page_id % 12 IN (0, 2, 3, 9) AS shell, page_id % 12 IN (5, 11) AS blocked FROM pages")
def shell_detector(spark, sf_dir):
    d = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_SHELL_HTML} AS html", f"{_SHELL_LINKS} AS links")
    html, at = F.col("html"), F.lit("https://e.edu/")
    return d.select("page_id", P.looks_like_shell(html, T.html_text(html), F.col("links")).alias("shell"), P.is_hard_block(at, F.lit(None).cast("string"), html).alias("blocked"))


@query(
    "SELECT page_id, reason, CASE WHEN reason IS NULL OR page_id % 5 <> 1 THEN 'http' ELSE 'browser' END AS engine, CASE WHEN reason IS NULL OR page_id % 5 = 4 THEN '' WHEN page_id % 5 = 1 THEN 'seen' WHEN page_id % 5 = 2 THEN 'needs_manual_check' WHEN page_id % 5 = 3 THEN 'needs_manual_check,other' ELSE 'needs_manual_check' END AS warnings "
    "FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 3 = 0 THEN NULL WHEN page_id % 12 IN (0, 2, 3, 9) THEN 'js_rendered_shell' WHEN page_id % 12 IN (1, 7, 8, 10) THEN 'no_useful_links' END AS reason FROM pages)"
)
def browser_fallback_choice(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "CAST(page_id AS STRING) AS url", f"{_SHELL_HTML} AS html", f"{_SHELL_LINKS} AS links", "page_id % 7 <> 0 AS ok", "page_id % 11 <> 0 AS is_html", "page_id % 3 = 1 AS is_home", "CASE WHEN page_id % 3 = 2 THEN 6 ELSE 5 END AS score")
    html, none = F.col("html"), F.lit(None).cast("string")
    reason = P.fallback_reason(F.col("ok"), F.col("is_html"), F.col("url"), none, html, T.html_text(html), F.col("links"), F.col("is_home"), F.col("score"))
    browser = p.where("page_id % 5 <> 4").selectExpr("url", "page_id % 5 = 1 AS ok", "CASE page_id % 5 WHEN 1 THEN array('seen') WHEN 2 THEN array('fetch_failed') WHEN 3 THEN array('fetch_failed', 'other') ELSE CAST(array() AS array<string>) END AS warnings")
    out = P.with_fallback(p.select("page_id", "url", reason.alias("reason"), F.array().cast("array<string>").alias("warnings")), browser)
    return out.select("page_id", "reason", "engine", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT status, warning, count(*) AS n FROM (SELECT 200 + 100 * (o_orderkey % 4) AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'parse_failed' WHEN o_orderkey % 4 >= 2 THEN 'fetch_failed' ELSE '' END AS warning FROM orders) GROUP BY ALL")
def fetch_contract(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("200 + 100 * (o_orderkey % 4) AS status", "CASE WHEN o_orderkey % 3 = 0 THEN array('parse_failed') ELSE CAST(array() AS array<string>) END AS warnings")
    return d.groupBy("status", F.array_join(P.checked_fetch(F.col("status"), F.col("warnings")), ",").alias("warning")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_suppkey AS scan_id, l_partkey AS url, l_linenumber % 5 AS origin_order, l_orderkey AS position FROM lineitem), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, url ORDER BY origin_order, position) AS n FROM c) WHERE n = 1 AND url % 4 <> 0) SELECT scan_id, url, origin_order, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY origin_order, position, url) AS rank FROM f) WHERE rank <= 50")
def api_candidates_first(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS scan_id", "l_partkey AS url", "l_linenumber % 5 AS origin_order", "l_orderkey AS position")
    return P.first_candidates(c, c.where("url % 4 = 0")).select("scan_id", "url", "origin_order", "rank")


@query("SELECT state, count(*) AS candidates FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'not_captured' WHEN p_partkey % 5 = 0 THEN 'failed' WHEN p_size > 20 THEN 'rows' ELSE 'empty' END AS state FROM part) GROUP BY state")
def api_capture_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    captures = p.where("p_partkey % 4 <> 0").selectExpr("p_partkey AS url", "CASE WHEN p_partkey % 5 = 0 THEN 503 ELSE 200 END AS status", "greatest(p_size - 20, 0) AS rows")
    return P.capture_status(p.selectExpr("p_partkey AS url"), captures)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def payload_keys(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"extra": 1, "k": 2}')).otherwise(F.col("props")).alias("body"))
    return d.select("event_id", P.unknown_keys(F.col("body"), ("k",)).alias("unknown"))


#: Catalogue diagnostics by case: what differs from nothing found, why no API was, and the action that follows.
_ZERO = "api_endpoints static_triggered assets assets_fetched assets_rejected endpoint_hints browser_triggered browser_captured browser_rejected network_responses dynamic_shells candidates".split()
_ACTIONS = (
    ({}, "no_catalog_source", "improve_source_acquisition"),
    ({"pagination_incomplete": "true", "api_endpoints": 1}, None, "expand_api_pagination"),
    ({"filter_budget_hit": "true", "candidates": 1}, "no_api_endpoint_hints", "enumerate_api_filters"),
    ({"filter_dimensions": 2, "filter_attempted": 1, "candidates": 1}, "no_api_endpoint_hints", "enumerate_api_filters"),
    ({"api_responses": 2, "api_endpoints": 1, "candidates": 1}, None, "implement_api_field_mapping"),
    ({"api_endpoints": 1, "candidates": 1}, None, "discover_public_catalog_api"),
    ({"browser_triggered": "true", "browser_captured": 1, "candidates": 2}, "browser_capture_no_network_json", "discover_public_catalog_api"),
    ({"browser_triggered": "true", "browser_rejected": 1, "candidates": 2}, "browser_capture_failed", "capture_browser_network_api"),
    ({"browser_triggered": "true", "network_responses": 3, "candidates": 2}, "browser_capture_no_catalog_api_candidate", "inspect_api_response_body"),
    ({"static_triggered": "true", "assets": 2, "assets_fetched": 1, "candidates": 1}, "static_asset_no_endpoint_hints", "discover_public_catalog_api"),
    ({"static_triggered": "true", "assets": 2, "assets_rejected": 2, "candidates": 1}, "static_asset_fetch_failed", "discover_public_catalog_api"),
    ({"static_triggered": "true", "candidates": 1}, "static_asset_no_script_assets", "discover_public_catalog_api"),
    ({"dynamic_shells": 1, "candidates": 1}, "browser_network_capture_not_triggered", "capture_browser_network_api"),
    ({"candidates": 3, "accepted": 3, "budget_skipped": 1}, "no_api_endpoint_hints", "increase_catalog_crawl_budget"),
    ({"candidates": 3, "accepted": 3, "acquisition_issues": 1}, "no_api_endpoint_hints", "improve_source_acquisition"),
    ({"candidates": 3}, "no_api_endpoint_hints", "improve_table_segmentation"),
    ({"candidates": 3, "accepted": 3, "false_positives": 1}, "no_api_endpoint_hints", "tighten_catalog_false_positive_filters"),
    ({"candidates": 3, "accepted": 9, "family_bias": "true"}, "no_api_endpoint_hints", "review_source_family_bias"),
    ({"candidates": 9, "accepted": 3}, "no_api_endpoint_hints", "improve_table_segmentation"),
    ({"candidates": 12, "accepted": 5}, "no_api_endpoint_hints", "none"),
    ({"candidates": 4, "accepted": 9, "zero_row_sources": 2}, "no_api_endpoint_hints", "improve_table_segmentation"),
    ({"candidates": 3, "accepted": 9, "raw_rows": 1, "warnings": 9}, "no_api_endpoint_hints", "tighten_catalog_false_positive_filters"),
    ({"candidates": 3, "accepted": 9, "raw_rows": 1, "warnings": 8}, "no_api_endpoint_hints", "manual_review_raw_rows"),
    ({"candidates": 3, "accepted": 9}, "no_api_endpoint_hints", "none"),
)


@query("SELECT o_orderkey, " + case("o_orderkey", *(text(r) if r else "NULL" for _, r, _ in _ACTIONS)) + " AS zero_reason, " + case("o_orderkey", *(text(a) for _, _, a in _ACTIONS)) + " AS action FROM orders")
def next_action(spark, sf_dir):
    flags = {"pagination_incomplete", "filter_budget_hit", "family_bias", "static_triggered", "browser_triggered"}
    names = [k for k in dict.fromkeys([*P.ACTION_INPUTS, *_ZERO]) if k != "zero_reason"]
    cases = spark.createDataFrame([(i, *(bool(given.get(k)) if k in flags else given.get(k, 0) for k in names)) for i, (given, _, _) in enumerate(_ACTIONS)], "kind long, " + ", ".join(f"{k} {'boolean' if k in flags else 'int'}" for k in names))
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"o_orderkey % {len(_ACTIONS)} AS kind").join(F.broadcast(cases), "kind")
    c = {k: F.col(k) for k in [*names, "zero_reason"]}
    return d.withColumn("zero_reason", P.api_zero_reason(c)).select("o_orderkey", "zero_reason", P.next_action(c).alias("action"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN false ELSE NOT (ends_with(lower({sql_path('url')}), '.pdf') AND contains(lower({sql_path('url')}), 'terms')) AND contains(url, 'example') END AS allowed FROM {PAGES_SQL}")
def follow_allowed(spark, sf_dir):
    d = derived_pages(spark, sf_dir).withColumn("u", F.when(F.col("page_id") % 3 == 0, F.lit("https://elsewhere.org/admissions")).otherwise(F.col("url")))
    u = F.col("u")
    return d.select("page_id", (U.is_allowed(u, "www.example.edu.sg", "example.edu.sg") & ~U.is_low_value(u)).alias("allowed"))


@query("SELECT o_orderkey % 6 AS kind, count(*) AS n, o_orderkey % 6 IN (0, 2, 4) AS follow FROM orders GROUP BY ALL")
def follow_filter(spark, sf_dir):
    url = case("o_orderkey", "'https://e.edu.sg/admissions'", "'https://e.edu.sg/news'", "'https://a.e.edu.sg/fees'", "'https://other.org/fees'", "'https://e.edu.sg/'", "'ftp://e.edu.sg/fees'")
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 6 AS kind", f"{url} AS url")
    u = F.col("url")
    return d.groupBy("kind", V.should_follow(u, U.is_allowed(u, "e.edu.sg", "e.edu.sg")).alias("follow")).agg(F.count("*").alias("n"))


@query("SELECT page_id, link FROM (SELECT page_id, unnest(CASE page_id % 2 WHEN 0 THEN ['https://h.edu/a/x.html', 'https://h.edu/r', 'https://h.edu/a/b.html?q=1'] ELSE ['https://o.edu/z', 'https://p.edu/k', 'https://h.edu/a/' || page_id] END) AS link FROM pages)")
def links_absolute(spark, sf_dir):
    html = case("page_id", "'<a href=\"x.html\"><a href=\"/r\"><a href=\"?q=1\"><a href=\"mailto:a@b\">'", "'<a href=\"https://o.edu/z\"><a href=\"//p.edu/k\"><a href=\"' || page_id || '\"><a href=\"javascript:x\">'")
    d = table(spark, sf_dir, "pages").selectExpr("page_id", f"{html} AS html")
    return d.select("page_id", F.explode(F.transform(T.links(F.col("html")), lambda x: T.absolute(x, F.lit("https://h.edu/a/b.html")))).alias("link"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 IN (0, 3)")
def ambiguous_group(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 3 = 0 AS requires", "CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 3 THEN NULL ELSE 'local' END AS applicant_group")
    return d.where(F.col("requires") & E.unknownish(F.col("applicant_group"), F.lit("known"))).select("o_orderkey")


@query(f"SELECT low, count(*) AS n FROM (SELECT page_id % 4 <= 1 AS low FROM {PAGES_SQL}) GROUP BY low")
def low_confidence_pages(spark, sf_dir):
    return derived_pages(spark, sf_dir).groupBy(G.low_confidence((F.col("page_id") % 4).cast("int")).alias("low")).agg(F.count("*").alias("n"))
