"""Captured responses: contracts, redaction, browser fallback, API bodies, candidates and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import contains_any
from tessera.functions.text import collapsed

BODY_LIMIT = 2_000_000


def plain_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def shortened(value: Column, most: int = 160) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def redacted(params: Column) -> Column:
    """Query values of sensitive keys hidden, the others cut to 160 characters."""
    return F.transform_values(params, lambda k, v: F.when(plain_key(k).isin(*R.SENSITIVE_QUERY_KEYS), F.lit("[redacted]")).otherwise(shortened(v)))


def safe_headers(headers: Column) -> Column:
    """Kept headers, their names in lower case and their values cut to 160 characters."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.transform_values(F.map_filter(lower, lambda k, _: k.isin(*R.SAFE_RESPONSE_HEADERS)), lambda _, v: shortened(v))


def plain_type(content_type: Column) -> Column:
    """A content type without its parameters, in lower case."""
    return F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0])


def is_api_url(url: Column) -> Column:
    path = F.lower(U.path(url))
    return path.contains("/api/") | path.endswith(".json") | path.contains("/graphql") | path.contains("/odata/")


def captured_responses(responses: DataFrame) -> DataFrame:
    """What is kept of network responses (.., url, method, status, headers, body): those with a JSON content type or an
    address like an API's. Bodies of JSON answers to GET are kept within the limit; query values and headers are cut to
    what is permitted. Other columns stay."""
    stated = F.try_element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), F.lit("content-length")).try_cast("long")
    kind = plain_type(F.try_element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), F.lit("content-type")))
    asked = (F.upper("method") == "GET") & kind.isin(*R.JSON_CONTENT_TYPES) & (F.coalesce(stated, F.lit(0)) <= BODY_LIMIT)
    length = F.coalesce(F.octet_length("body"), F.lit(0))
    kept = F.when(asked & length.between(1, BODY_LIMIT), F.col("body"))
    return responses.where(kind.isin(*R.JSON_CONTENT_TYPES) | is_api_url(F.col("url"))).withColumns(
        {
            "method": F.upper("method"),
            "content_type": kind,
            "size": F.when(asked & (length > 0), length.cast("long")).otherwise(stated),
            "query": redacted(U.query_map(F.col("url"))),
            "headers": safe_headers(F.col("headers")),
            "body": kept,
            "sha256": F.sha2(kept, 256),
            "truncated": (F.coalesce(stated, F.lit(0)) > BODY_LIMIT) | (asked & (length > BODY_LIMIT)),
        }
    )


def thin_text(plain: Column) -> Column:
    return F.length(collapsed(plain)) < 500


def looks_like_shell(html: Column, plain: Column, links: Column) -> Column:
    """A page that a browser has to render: one link at most, and an application's root, a framework's state, a plea for
    scripts, or many scripts around little text."""
    lower = F.lower(html)
    marked = lower.rlike(R.APP_ROOT_PATTERN) | contains_any(lower, R.FRAMEWORK_STATE_TERMS)
    plea = contains_any(F.lower(plain), R.SCRIPT_PLEA_TERMS) & lower.contains("<script")
    return (links <= 1) & (marked | plea | ((F.regexp_count(lower, F.lit("<script")) >= 4) & thin_text(plain)))


def is_hard_block(url: Column, title: Column, text: Column) -> Column:
    """A block page: its terms, or both robot rules together with what states them."""
    hay = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 4000)))
    return contains_any(hay, R.HARD_BLOCK_TERMS) | (hay.contains("noindex") & hay.contains("nofollow") & (hay.contains("robots") | hay.contains("<meta")))


def fallback_reason(ok: Column, is_html: Column, url: Column, title: Column, html: Column, plain: Column, links: Column, is_home: Column, score: Column) -> Column:
    """Why a browser should fetch a page again, else null: only fine HTML that isn't blocked and is worth it."""
    asked = ok & is_html & ~is_hard_block(url, title, html) & (is_home | (score >= 6))
    return F.when(asked & looks_like_shell(html, plain, links), "js_rendered_shell").when(asked & (links == 0) & thin_text(plain), "no_useful_links")


def with_fallback(primary: DataFrame, browser: DataFrame) -> DataFrame:
    """The browser's row where there is a reason and the browser succeeded; where it failed, the primary row with the
    browser's warnings, a failed fetch among them turned into one to check by hand.
    primary: url, reason, warnings array<string>; browser: url, ok, warnings."""
    b = browser.select("url", F.col("ok").alias("_ok"), F.col("warnings").alias("_warnings"))
    asked, ok, check = F.col("reason").isNotNull() & F.col("_ok").isNotNull(), F.coalesce("_ok", F.lit(False)), F.lit("needs_manual_check")
    own = F.when(F.size("_warnings") > 0, F.transform("_warnings", lambda w: F.when(w == "fetch_failed", check).otherwise(w))).otherwise(F.array(check))
    warnings = F.when(asked & ok, F.col("_warnings")).when(asked, F.concat("warnings", own)).otherwise(F.col("warnings"))
    return primary.join(b, "url", "left").withColumns({"engine": F.when(asked & ok, "browser").otherwise("http"), "warnings": warnings}).drop("_ok", "_warnings")


def checked_fetch(status: Column, warnings: Column) -> Column:
    """Warnings of a fetch: a failed one without a warning gets one."""
    return F.when((status >= 400) & (F.size(warnings) == 0), F.array(F.lit("fetch_failed"))).otherwise(warnings)


def first_candidates(candidates: DataFrame, seen: DataFrame, most: int = 50) -> DataFrame:
    """New candidate URLs of each scan: the first origin of each, not seen before, in origin order up to the budget."""
    w = Window.partitionBy("scan_id", "url").orderBy("origin_order", "position")
    first = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(seen.select("scan_id", "url").distinct(), ["scan_id", "url"], "left_anti")
    budget = Window.partitionBy("scan_id").orderBy("origin_order", "position", "url")
    return first.withColumn("rank", F.row_number().over(budget)).where(F.col("rank") <= most)


def capture_status(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    c = captures.select("url", "status", F.col("rows").alias("_rows"))
    state = F.when(F.col("status").isNull(), "not_captured").when(F.col("status") >= 400, "failed").when(F.col("_rows") > 0, "rows").otherwise("empty")
    return candidates.join(c, "url", "left").groupBy(state.alias("state")).agg(F.count("*").alias("candidates"))


def unknown_keys(body: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object beyond the allowed ones, sorted."""
    return F.array_join(F.array_sort(F.array_except(F.json_object_keys(body), F.array(*map(F.lit, allowed)))), ",")


#: What next_action looks at: counts and flags of a catalogue's diagnostics; absent ones are 0, false or null.
ACTION_INPUTS = "pagination_incomplete filter_budget_hit filter_dimensions filter_attempted filter_fetched api_responses api_accepted api_endpoints accepted zero_reason dynamic_shells budget_skipped not_crawled candidates acquisition_issues false_positives family_bias zero_row_sources raw_rows warnings".split()


def api_zero_reason(c: dict[str, Column]) -> Column:
    """Why no API endpoint was found, else null: static assets first, then the browser, then the sources. Keys:
    api_endpoints, static_triggered, assets, assets_fetched, assets_rejected, endpoint_hints, browser_triggered,
    browser_captured, browser_rejected, network_responses, dynamic_shells, candidates."""
    static, browser = c["static_triggered"], c["browser_triggered"]
    none = F.lit(None).cast("string")
    return (
        F.when(c["api_endpoints"] > 0, none)
        .when(static & (c["assets_fetched"] > 0) & (c["endpoint_hints"] == 0), "static_asset_no_endpoint_hints")
        .when(static & (c["assets"] > 0) & (c["assets_rejected"] > 0) & (c["assets_fetched"] == 0), "static_asset_fetch_failed")
        .when(static & (c["assets"] == 0), "static_asset_no_script_assets")
        .when(browser & (c["browser_captured"] > 0) & (c["network_responses"] == 0), "browser_capture_no_network_json")
        .when(browser & (c["browser_rejected"] > 0) & (c["browser_captured"] == 0), "browser_capture_failed")
        .when(browser & (c["network_responses"] > 0), "browser_capture_no_catalog_api_candidate")
        .when(c["dynamic_shells"] > 0, "browser_network_capture_not_triggered")
        .when(c["candidates"] == 0, "no_catalog_source")
        .otherwise("no_api_endpoint_hints")
    )


def low_row_yield(candidates: Column, accepted: Column) -> Column:
    many = (candidates >= 8) & (accepted <= F.greatest(F.lit(3), F.floor(candidates / 3)))
    return many | ((candidates >= 4) & (accepted <= 2))


def many_zero_row_sources(candidates: Column, zero_rows: Column) -> Column:
    return (candidates >= 2) & (zero_rows >= F.greatest(F.lit(2), F.floor(candidates / 2)))


def probably_incomplete(c: dict[str, Column]) -> Column:
    """Whether a catalogue probably lacks rows."""
    nothing = (c["candidates"] > 0) & (c["accepted"] == 0)
    unread = (c["dynamic_shells"] > 0) | many_zero_row_sources(c["candidates"], c["zero_row_sources"]) | (c["budget_skipped"] > 0) | (c["not_crawled"] > 0) | (c["acquisition_issues"] > 0)
    return nothing | low_row_yield(c["candidates"], c["accepted"]) | unread | ((c["accepted"] > 0) & (c["raw_rows"] > 0))


def next_action(c: dict[str, Column]) -> Column:
    """What to do about a catalogue: the first that applies. Keys: ACTION_INPUTS."""
    none, reason = c["accepted"] == 0, F.coalesce(c["zero_reason"], F.lit(""))
    thin = low_row_yield(c["candidates"], c["accepted"]) | many_zero_row_sources(c["candidates"], c["zero_row_sources"])
    return (
        F.when(c["pagination_incomplete"], "expand_api_pagination")
        .when(c["filter_budget_hit"] | ((c["filter_dimensions"] > 0) & (c["filter_attempted"] > 0) & (c["filter_fetched"] == 0)), "enumerate_api_filters")
        .when((c["api_responses"] > 0) & (c["api_accepted"] == 0) & none, "implement_api_field_mapping")
        .when(((c["api_endpoints"] > 0) & (c["api_responses"] == 0) & none) | (reason == "browser_capture_no_network_json"), "discover_public_catalog_api")
        .when(reason == "browser_capture_failed", "capture_browser_network_api")
        .when(reason == "browser_capture_no_catalog_api_candidate", "inspect_api_response_body")
        .when(reason.isin("static_asset_no_endpoint_hints", "static_asset_fetch_failed", "static_asset_no_script_assets"), "discover_public_catalog_api")
        .when((c["dynamic_shells"] > 0) & none, "capture_browser_network_api")
        .when((c["budget_skipped"] > 0) | (c["not_crawled"] > 0), "increase_catalog_crawl_budget")
        .when((c["candidates"] == 0) | (c["acquisition_issues"] > 0), "improve_source_acquisition")
        .when(none, "improve_table_segmentation")
        .when(c["false_positives"] > 0, "tighten_catalog_false_positive_filters")
        .when(c["family_bias"], "review_source_family_bias")
        .when(thin, "improve_table_segmentation")
        .when((c["raw_rows"] > 0) & (c["warnings"] >= c["accepted"]), "tighten_catalog_false_positive_filters")
        .when((c["raw_rows"] > 0) | probably_incomplete(c), "manual_review_raw_rows")
        .otherwise("none")
    )
