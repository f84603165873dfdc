"""Coverage, attempts and reasons of a scan, and rules that depend on the order in which pages were captured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import urls as U
from tessera.functions.columns import nullif_empty
from tessera.functions.rules import CORE_FIELDS, FIELD_CAPABILITIES
from tessera.operators.captures import low_row_yield


def claim_index(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Dense index from 0 of each claim within its field, in capture order."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def kept_supplements(attempts: DataFrame) -> DataFrame:
    """Supplements that fill a field still empty at their page: those of the first supplement page before any routed
    claim. Rows: scan_id, field, page_order, route (whether routed)."""
    w = Window.partitionBy("scan_id", "field")
    first_route = F.min(F.when(F.col("route"), F.col("page_order"))).over(w)
    first_other = F.min(F.when(~F.col("route"), F.col("page_order"))).over(w)
    rows = attempts.withColumn("r", first_route).withColumn("s", first_other)
    return rows.where(F.col("route") | ((F.col("page_order") == F.col("s")) & (F.col("r").isNull() | (F.col("s") < F.col("r"))))).drop("r", "s")


def coverage(claims: DataFrame, fields: tuple[str, ...] = CORE_FIELDS) -> DataFrame:
    """Per scan: core fields found, missing (in the fields' order) and the found share, rounded to three places."""
    found = claims.groupBy("scan_id").agg(*(F.coalesce(F.bool_or(F.when(F.col("field") == f, F.col("known"))), F.lit(False)).alias(f) for f in fields))
    n = sum((F.col(f).cast("int") for f in fields), F.lit(0))
    missing = F.array_join(F.filter(F.array(*(F.when(~F.col(f), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
    return found.select("scan_id", n.cast("long").alias("found"), missing.alias("missing"), F.round(n / len(fields), 3).alias("ratio"))


def missing_reasons(attempts: DataFrame) -> DataFrame:
    """Per scan and field without an extracted value the most telling reason among its attempts."""
    a = attempts.groupBy("scan_id", "field").agg(
        F.bool_or(F.col("status") == "extracted").alias("extracted"),
        F.bool_and("blocked").alias("all_blocked"),
        F.bool_or(~F.col("blocked") & (F.col("reason") == "raw_needs_manual_review")).alias("raw"),
        F.bool_or(~F.col("blocked") & (F.col("status") == "no_match")).alias("no_match"),
        F.bool_or(~F.col("blocked") & F.col("reason").isin("context_gate_failed", "undergraduate_context_gate_failed")).alias("gate"),
        F.bool_or("portal").alias("portal"),
    )
    reason = F.when(F.col("all_blocked"), "blocked_or_challenge").when(F.col("raw"), "raw_needs_manual_review").when(F.col("no_match"), "attempted_no_match").when(F.col("gate"), "context_gate_failed").when(F.col("portal"), "portal_or_login_required").otherwise("manual_check_required")
    return a.where(~F.col("extracted")).select("scan_id", "field", reason.alias("canonical_reason"))


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Counts by status, by field and by both, in one pass."""
    return attempts.groupingSets([["field", "status"], ["field"], ["status"]], "field", "status").agg(F.count("*").alias("n"))


def family_bias(rows: DataFrame, least_rows: int = 5, least_families: int = 2, share: float = 0.75) -> DataFrame:
    """Per scan the family with the most rows, its share, and whether the scan leans on it."""
    by_family = rows.groupBy("scan_id", "family").agg(F.count("*").alias("n"))
    top = by_family.groupBy("scan_id").agg(F.max_by("family", F.struct("n", "family")).alias("family"), F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("families"))
    family_share = F.round(F.col("top") / F.col("total"), 3)
    return top.select("scan_id", "family", "families", family_share.alias("family_url_share"), ((F.col("total") >= least_rows) & (F.col("families") >= least_families) & (F.col("top") / F.col("total") >= share)).alias("biased"))


def status_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of distinct (url, label); a candidate without a label is a ``candidate_source``."""
    named = labels.join(candidates.select("url").distinct(), "url", "left_semi").select("url", "label").distinct()
    rest = candidates.select("url").distinct().join(named, "url", "left_anti").withColumn("label", F.lit("candidate_source"))
    return named.unionByName(rest).groupBy("label").agg(F.count("*").alias("urls"))


def rehomed_prerequisites(rows: DataFrame) -> DataFrame:
    """A prerequisite page goes to programme 0 if its scan has a programme on an earlier page, else it becomes an
    accepted qualification. Rows: scan_id, page_order, kind (programme, prerequisite)."""
    before = Window.partitionBy("scan_id").orderBy("page_order", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col("kind") == "programme", 1)).over(before), F.lit(0)) == 1
    target = F.when(F.col("kind") == "programme", "programme").when(seen, "/programmes/0/prerequisites").otherwise("/admissions/accepted_qualifications")
    return rows.withColumn("target", target)


def capability_matrix(spark: SparkSession) -> DataFrame:
    """What each core field comes from; nine rows, a dimension for diagnostics."""
    rows = spark.createDataFrame(list(FIELD_CAPABILITIES), "field string, claim_path string, categories string, gates string, extractors string, suggested string")
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c)
    return rows.select("field", "claim_path", *(listed(c) for c in ("categories", "gates", "extractors", "suggested")))


def catalog_candidates(pages: DataFrame, attempts: DataFrame, rows: DataFrame) -> DataFrame:
    """(scan_id, url): sources that may list programmes, by the category of a page (scan_id, url, category; from the
    classifier and from the strategy), by an attempt at the catalogue, or by a row of it (source_url)."""
    listed = pages.where(F.col("category").isin("programme_list", "programme_prerequisites")).select("scan_id", "url")
    tried = attempts.where("field = 'programme_catalog'").select("scan_id", "url")
    named = rows.where("source_url <> ''").select("scan_id", F.col("source_url").alias("url"))
    return listed.unionByName(tried).unionByName(named).where("url is not null").distinct()


def filter_rollup(outcomes: DataFrame) -> DataFrame:
    """Per scan the distinct values of each filter dimension, requests by outcome, and whether a budget was hit.
    outcomes: scan_id, dimensions map<string, array<string>>, attempted, fetched, rejected (arrays), budget_hit."""
    values = outcomes.select("scan_id", F.explode("dimensions").alias("k", "vs")).select("scan_id", "k", F.explode_outer("vs").alias("v"))
    by_key = values.groupBy("scan_id", "k").agg(F.array_sort(F.collect_set(F.when(F.col("v") != "", F.col("v")))).alias("vs"))
    dimensions = by_key.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("k", "vs"))).alias("dimensions"))
    size = lambda c: F.sum(F.coalesce(F.array_size(c), F.lit(0))).alias(c)
    counts = outcomes.groupBy("scan_id").agg(*(size(c) for c in ("attempted", "fetched", "rejected")), F.bool_or("budget_hit").alias("budget_hit"))
    return counts.join(dimensions, "scan_id", "left")


def applied_suggestions(suggested: DataFrame, sources: DataFrame, filled: DataFrame, names: DataFrame) -> DataFrame:
    """``suggested`` (scan_id, position, claim_path, value, source_url; accepted ones) with ``write_status``. A path takes
    its first suggestion and none where it is ``filled`` (scan_id, claim_path); catalogue names (``names``: scan_id,
    name) take each new one."""
    known = sources.select("scan_id", "source_url", F.lit(True).alias("_source")).distinct()
    full = filled.select("scan_id", "claim_path", F.lit(True).alias("_full")).distinct()
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    had = names.select("scan_id", norm(F.col("name")).alias("_name"), F.lit(True).alias("_had")).distinct()
    rows = suggested.withColumn("_name", norm(F.col("value"))).join(known, ["scan_id", "source_url"], "left").join(full, ["scan_id", "claim_path"], "left").join(had, ["scan_id", "_name"], "left")
    name = F.col("claim_path") == "programme_catalog[].name"
    live = F.col("_source").isNotNull() & F.col("_full").isNull()
    before = lambda *key: Window.partitionBy("scan_id", "claim_path", *key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda *key: F.coalesce(F.max(live).over(before(*key)), F.lit(False))
    rows = rows.withColumns({"_first": ~earlier(), "_new": F.col("_had").isNull() & ~earlier("_name")})
    single = F.col("claim_path").startswith("admissions.")
    status = (
        F.when(F.col("_source").isNull(), "source_record_missing")
        .when(F.col("_full").isNotNull() | (single & ~F.col("_first")), "existing_value")
        .when(name & ~F.col("_new"), "duplicate_value")
        .when(single | name, "applied")
        .otherwise("unsupported_claim_path_for_write")
    )
    return rows.withColumn("write_status", status).drop("_name", "_source", "_full", "_had", "_first", "_new")


def planned_status(accepted: DataFrame, crawled: DataFrame) -> DataFrame:
    """``accepted`` planner addresses (.., scan_id, url) with ``crawl_status`` after the second pass: whether their
    canonical form is among the captured ones (scan_id, url)."""
    seen = crawled.select(F.col("scan_id").alias("_scan"), U.canonical_url(F.col("url")).alias("_key"), F.lit(True).alias("_seen")).distinct()
    rows = accepted.withColumn("_own", U.canonical_url(F.col("url"))).join(seen, (F.col("scan_id") == F.col("_scan")) & (F.col("_own") == F.col("_key")), "left")
    return rows.withColumn("crawl_status", F.when(F.col("_seen"), "crawled").otherwise("budget_skipped")).drop("_scan", "_key", "_seen", "_own")


def catalog_summary(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per scan of catalogue ``rows`` (scan_id, position, name, category, faculty_or_school, parse_status, source_url,
    warnings) and candidate sources (scan_id, url): counts by type, faculty, status and source, duplicate names as they
    first occur, rows to review, warnings, rows to a source and whether that is few."""
    unparsed = F.col("parse_status") != "parsed"
    one = lambda test: F.sum(test.cast("long"))
    base = rows.groupBy("scan_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("source_url").alias("sources"),
        one(unparsed).alias("raw_rows"),
        one(unparsed | (F.size("warnings") > 0)).alias("to_review"),
        F.sum(F.size("warnings")).cast("long").alias("warnings"),
    )

    def counted(column: str) -> DataFrame:
        named = F.coalesce(nullif_empty(F.col(column)), F.lit("unknown")).alias("k")
        by = rows.groupBy("scan_id", named).agg(F.count("*").alias("n"))
        return by.groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"by_{column}"))

    norm = F.lower(F.trim(F.regexp_replace("name", r"(?U)\s+", " ")))
    names = rows.groupBy("scan_id", norm.alias("k")).agg(F.min_by("name", "position").alias("name"), F.count("*").alias("n")).where("n > 1 and k <> ''")
    duplicates = names.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", "n"))).alias("duplicate_names"), F.sum(F.col("n") - 1).alias("duplicates"))
    sources = candidates.distinct().groupBy("scan_id").agg(F.count("*").alias("candidates"))
    out = base.join(sources, "scan_id", "full")
    for column in ("category", "faculty_or_school", "parse_status"):
        out = out.join(counted(column), "scan_id", "left")
    out = out.join(duplicates, "scan_id", "left").na.fill(0, ["rows", "sources", "raw_rows", "to_review", "warnings", "candidates", "duplicates"])
    ratio = F.when(F.col("candidates") > 0, F.round(F.col("rows") / F.col("candidates"), 3))
    return out.withColumns({"rows_to_candidates": ratio, "low_row_yield": low_row_yield(F.col("candidates"), F.col("rows"))})


def api_groups(entries: DataFrame) -> DataFrame:
    """Per scan and paged endpoint what its answers gave. entries: scan_id, url, candidate_objects, accepted, rejected,
    total or null, pages or null, complete, incomplete, budget_hit. A group is incomplete if a budget was hit, rows lack
    to its total, or, with no total, an answer says so and none says it is complete."""
    total, accepted = F.col("total"), F.col("accepted")
    groups = entries.groupBy("scan_id", F.coalesce(U.page_group_url(F.col("url")), F.lit("unknown")).alias("group_url")).agg(
        *(F.sum(c).alias(c) for c in ("candidate_objects", "accepted", "rejected")),
        F.max("total").alias("total"),
        F.max(F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1))).alias("pages"),
        *(F.bool_or(c).alias(c) for c in ("complete", "incomplete", "budget_hit")),
        F.count("*").alias("responses"),
    )
    lacks = F.col("budget_hit") | F.when(total.isNotNull(), accepted < total).otherwise(F.col("incomplete") & ~F.col("complete"))
    whole = F.when(total.isNotNull(), accepted >= total).otherwise(F.col("complete"))
    return groups.withColumns({"is_incomplete": lacks, "is_complete": whole})


def api_rollup(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Per scan its endpoints together, and how many of the catalogue's ``rows`` (scan_id) came from them."""
    number = lambda c: F.sum(c).alias(c)
    out = groups.groupBy("scan_id").agg(*(number(c) for c in ("responses", "pages", "candidate_objects", "accepted", "rejected", "total")), F.bool_or("is_incomplete").alias("incomplete"), F.bool_and("is_complete").alias("_whole"))
    made = rows.groupBy("scan_id").agg(F.count("*").alias("_rows"))
    out = out.join(made, "scan_id", "left")
    return out.withColumns({"complete": F.col("_whole") & ~F.col("incomplete"), "api_to_rows": F.round(F.col("accepted") / F.col("_rows"), 3)}).drop("_whole", "_rows")
