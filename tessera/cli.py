"""Command line: scans of captured sites to result tables, JSON, a Markdown report and the catalogue's CSV.

``python -m tessera.cli SITE --fixture --output-dir OUT``. Live fetching, browsers and hosted models aren't part of this
library; their options are known, checked as ever, and end with a message.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import relevance as V
from tessera.functions import urls as U
from tessera.operators import catalogue, crawl, report, scan
from tessera.operators.diagnostics import missing_reasons
from tessera.operators.incremental import changed
from tessera.sources import captured, sinks
from tessera.sources.shared import checkpointed

SMOKE = (20, 2)  # pages, depth
FIXTURE = (20, 3)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Evidence-first scans of captured university sites")
    p.add_argument("input", nargs="?", help="folder of a captured site, or a live URL")
    p.add_argument("--config", help="JSON batch configuration of live scans")
    p.add_argument("--fixture", action="store_true", help="scan a folder")
    p.add_argument("--seed-url", default="https://fixture.test/")
    p.add_argument("--output-dir", default="outputs/university-scan")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--allowed-host", action="append", default=[])
    p.add_argument("--allowed-domain", action="append", default=[])
    p.add_argument("--previous-result", help="result.json of an earlier scan")
    for flag in ("auto", "enable-live-network", "smoke", "enable-llm", "no-llm", "deterministic-only"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--llm-provider", choices=["auto", "mock", "openai", "anthropic", "gemini", "none"])
    for flag in ("enable-classification-assist", "enable-source-planning", "enable-llm-structured-extraction"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--keyword-query")
    p.add_argument("--relevance-strategy", default="admissions-programme", choices=["admissions-programme", "rule-based", "bm25-like"])
    for flag in ("enable-browser", "enable-pdf"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--browser-wait-until", default="domcontentloaded", choices=["commit", "domcontentloaded", "load", "networkidle"])
    p.add_argument("--browser-headed", action="store_true")
    p.add_argument("--timeout-seconds", type=float)
    p.add_argument("--user-agent")
    p.add_argument("--enable-scrapegraph", action="store_true")
    return p


def checked(argv: list[str] | None = None) -> argparse.Namespace:
    """Arguments that go together; others end with a usage error."""
    p = parser()
    a = p.parse_args(argv)
    features = (a.enable_classification_assist, a.enable_source_planning, a.enable_llm_structured_extraction)
    rules = (
        ((a.no_llm or a.deterministic_only) and (a.enable_llm or a.llm_provider or any(features)), "--no-llm/--deterministic-only cannot be combined with LLM provider or feature flags."),
        (a.llm_provider and a.llm_provider != "none" and not a.enable_llm, "--llm-provider requires --enable-llm."),
        (a.enable_classification_assist and not a.enable_llm, "--enable-classification-assist requires --enable-llm."),
        (a.enable_source_planning and not a.enable_llm, "--enable-source-planning requires --enable-llm."),
        (a.enable_llm_structured_extraction and not a.enable_llm, "--enable-llm-structured-extraction requires --enable-llm."),
        (a.enable_llm and a.llm_provider in ("anthropic", "gemini"), "--llm-provider anthropic/gemini are reserved and not implemented."),
        (a.enable_llm and not any(features), "--enable-llm requires --enable-classification-assist, --enable-source-planning, or --enable-llm-structured-extraction."),
        (a.enable_scrapegraph, "ScrapeGraphAI mode is guarded and not implemented."),
        (not a.config and not a.input, "input is required unless --config is supplied."),
        (a.fixture and (a.enable_live_network or a.enable_browser), "--fixture cannot be combined with live network/browser modes."),
        (not a.fixture, "live fetching is not part of this library; scan a captured folder with --fixture."),
        (a.enable_llm, "hosted and mock models are not part of this library."),
    )
    for broken, message in rules:
        if broken:
            p.error(message)
    try:
        V.strategy(a.relevance_strategy, a.keyword_query)
    except ValueError as e:
        p.error(str(e))
    pages, depth = a.max_pages or FIXTURE[0], a.max_depth if a.max_depth is not None else FIXTURE[1]
    a.max_pages, a.max_depth = (min(pages, SMOKE[0]), min(depth, SMOKE[1])) if a.smoke else (pages, depth)
    return a


def scan_folder(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The tables of a scan of one folder."""
    score = V.strategy(a.relevance_strategy, a.keyword_query)
    base = a.seed_url
    host = spark.range(1).select(U.host(F.lit(base)).alias("h"), U.registrable_domain(U.host(F.lit(base))).alias("d")).first()
    allowed = lambda u: U.is_allowed(u, host.h, host.d, [host.h, *a.allowed_host], a.allowed_domain)
    site = captured.read_site(spark, a.input, base).withColumn("url", U.canonical_url(F.col("url")))
    links = F.filter(F.transform("links", lambda x: U.canonical_url(x, F.col("url"))), lambda u: allowed(u) & ~U.is_low_value(u))
    pages = checkpointed(site.withColumns({"scan_id": F.lit(0).cast("long"), "links": F.array_distinct(links), "score": score(F.col("url"), F.col("title"), F.col("text"))}))
    seed = spark.range(1).select(F.lit(0).cast("long").alias("scan_id"), U.canonical_url(F.lit(base)).alias("seed"))
    visits = checkpointed(crawl.best_first(pages, seed, a.max_pages, a.max_depth))
    visited = visits.join(pages.drop("scan_id", "score", "status"), "url").where("status = 200")
    out = scan.scanned(visited) | {"visits": visits, "captured": visited}
    out["attempts"], out["claims"] = checkpointed(out["attempts"]), checkpointed(out["claims"])
    out["catalog"] = catalogue.catalog_rows(visited, ["scan_id"], ["page_order"])
    return out


def write(spark: SparkSession, a: argparse.Namespace, made: dict) -> None:
    out = a.output_dir.rstrip("/")
    for name in ("pages", "attempts", "claims", "coverage", "warnings", "catalog"):
        made[name].write.mode("overwrite").parquet(f"{out}/tables/{name}")
    sources = made["captured"].select("scan_id", F.col("page_order").alias("position"), F.col("url").alias("source_url"), "title", "source_type", "retrieved_at", "content_hash")
    whole = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    result = sources.agg(whole(sources).alias("sources")).crossJoin(made["claims"].agg(whole(made["claims"]).alias("claims"))).crossJoin(made["coverage"].agg(F.first(F.struct("found", "missing", "ratio")).alias("coverage")))
    sinks.write_result_json(result, f"{out}/result.json")
    blocked = made["attempts"].select("scan_id", "field", "status", "reason", F.lit(False).alias("blocked"), F.lit(False).alias("portal"))
    known = made["claims"].select("scan_id", "field").distinct()
    reasons = missing_reasons(blocked).join(known, ["scan_id", "field"], "left_anti")
    judged = made["pages"].join(made["visits"].select("scan_id", "page_order", "score"), ["scan_id", "page_order"]).join(sources.select("scan_id", F.col("position").alias("page_order"), "title"), ["scan_id", "page_order"])
    scans = spark.range(1).select(F.lit(0).cast("long").alias("scan_id"), F.lit(a.seed_url).alias("input_url"), F.lit(captured.CAPTURED_AT).alias("retrieved_at"), F.lit("medium").alias("confidence"))
    warnings = made["warnings"].select("scan_id", F.lit(0).alias("position"), "code", "field", "message")
    previous = captured.read_previous(spark, a.previous_result)
    if previous is not None:
        stale = changed(sources.select("source_url", "content_hash"), previous, "source_url", "content_hash")
        warnings = warnings.unionByName(stale.select(F.lit(0).cast("long").alias("scan_id"), F.lit(1).alias("position"), F.lit("source_changed").alias("code"), F.col("source_url").alias("field"), F.lit("The source's content differs from the earlier result's.").alias("message")))
    lines = report.report_lines(scans, judged, made["attempts"], made["claims"], made["coverage"], warnings, sources, reasons)
    report.markdown(lines).select("body").write.mode("overwrite").text(f"{out}/report.md")
    if not made["catalog"].isEmpty():
        rows = made["catalog"].withColumn("position", F.regexp_extract("claim_path", "([0-9]+)", 1).cast("int"))
        none = spark.createDataFrame([], "scan_id long, university_id string, university_name string")
        sinks.write_catalogue_csv(catalogue.csv_rows(rows, sources, none).drop("scan_id"), f"{out}/programme_catalog.csv")


def main(argv: list[str] | None = None) -> int:
    a = checked(argv)
    spark = SparkSession.builder.getOrCreate()
    write(spark, a, scan_folder(spark, a))
    print(f"Wrote {a.output_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
