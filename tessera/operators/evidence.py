"""Claims against evidence and sources: joins that prove, contradict or age them.

Claims are long rows (scan_id, claim_path, label, value, status); evidence rows name a claim_path and a source_url;
sources have source_url, academic_year and is_official. All functions keep the keys they join on as they are given, so
a scan's rows stay together; null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import gates as G
from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import bound, contains_any

KEY = ["scan_id", "claim_path"]


def unknownish(value: Column, status: Column) -> Column:
    """Whether a claim states nothing: no value, or one that stands for not knowing."""
    return status.isin("unknown", "needs_manual_check") | value.isNull() | value.isin("unknown", "needs_manual_check")


def without_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Known claims that no evidence row names."""
    known = claims.where(~unknownish(F.col("value"), F.col("status")))
    return known.join(evidence.select(*KEY).distinct(), KEY, "left_anti")


def dangling(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence whose claim does not exist."""
    return evidence.join(claims.select(*KEY).distinct(), KEY, "left_anti")


def conflicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Labels with more than one value (trimmed, case apart) and the sources that support any of them."""
    known = claims.where(~unknownish(F.col("value"), F.col("status"))).select(*KEY, F.lower("label").alias("label"), F.lower(F.trim("value")).alias("value"))
    backed = known.join(evidence.select(*KEY, "source_url"), KEY, "left")
    grouped = backed.groupBy("scan_id", "label").agg(F.count_distinct("value").alias("values"), F.array_join(F.array_sort(F.collect_set("source_url")), ",").alias("source_urls"))
    return grouped.where(F.col("values") > 1)


def stale_sources(sources: DataFrame, current_year: int) -> DataFrame:
    """Sources whose latest four-digit academic year is before the given one."""
    years = F.transform(F.filter(F.split(F.replace("academic_year", F.lit("/"), F.lit("-")), "-"), lambda p: p.rlike("^[0-9]{4}$")), lambda p: p.cast("int"))
    return sources.withColumn("latest_year", F.array_max(years)).where(F.col("latest_year") < current_year)


def non_official_support(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    return evidence.join(sources.where(~F.col("is_official")).select("source_url"), "source_url")


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of every key in a total order; null keys count as equal."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def overall_confidence(warnings: DataFrame, evidence: DataFrame, scans: DataFrame) -> DataFrame:
    """LOW with a missing-evidence or conflict warning or without evidence, else MEDIUM."""
    bad = warnings.groupBy("scan_id").agg(F.bool_or(F.col("code").isin("missing_evidence", "conflict")).alias("bad"))
    has = evidence.select("scan_id").distinct().withColumn("has", F.lit(True))
    level = F.when(F.coalesce("bad", F.lit(False)), "low").when(F.coalesce("has", F.lit(False)), "medium").otherwise("low")
    return scans.join(bad, "scan_id", "left").join(has, "scan_id", "left").select("scan_id", level.alias("confidence"))


def suggested_context(path: Column, url: Column, title: Column, text: Column) -> Column:
    """Whether a page is of the kind that a suggested fact's path asks for."""

    def catalogue(hay: Column) -> Column:
        return ~contains_any(hay, R.CATALOG_CONTEXT_NOT) & contains_any(hay, R.CATALOG_CONTEXT)

    hay = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.substring(text, 1, 2500)))
    return (
        F.when(path.startswith("programme_catalog[]"), bound(hay, catalogue))
        .when(path == "admissions.requirements.english", G.english_context(url, title, text))
        .when(path == "admissions.fees", G.fee_context(url, title, text))
        .when(path == "admissions.scholarships", G.scholarship_context(url, title, text))
        .when(path.startswith("admissions."), G.undergraduate_context(url, title, text))
        .otherwise(False)
    )


def suggestions_judged(suggested: DataFrame, captured: DataFrame, allowed=None, least: float = R.SUGGESTED_CONFIDENCE) -> DataFrame:
    """``suggested`` (.., claim_path, value, evidence_snippet, source_url, source_title, confidence) with ``reason``: why
    each is refused, the first that applies, or null. ``captured``: source_url, text, title, is_official (null: the
    address has no source record); one row an address. ``allowed``: a policy that makes a column of an address."""
    own = captured.select(F.col("source_url").alias("_url"), F.col("text").alias("_text"), F.col("title").alias("_title"), F.col("is_official").alias("_official"))
    rows = suggested.join(own, F.col("source_url") == F.col("_url"), "left")
    title = F.when(F.col("_official").isNotNull(), F.col("_title")).otherwise(F.col("source_title"))
    outside = F.lit(False) if allowed is None else U.planner_reason(F.col("source_url"), allowed(F.col("source_url"))) != "accepted"
    broken = F.col("claim_path").isNull() | F.col("value").isNull() | F.col("evidence_snippet").isNull() | F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)
    reason = (
        F.when(broken, "malformed_candidate")
        .when(F.col("confidence") < least, "low_confidence")
        .when(~F.col("claim_path").isin(*R.SUGGESTED_CLAIM_PATHS), "claim_path_not_allowed")
        .when(F.col("_text").isNull(), "source_not_captured")
        .when(~F.coalesce("_official", F.lit(True)) | outside, "source_not_official")
        .when(~F.col("_text").contains(F.col("evidence_snippet")), "snippet_not_found")
        .when(~F.col("evidence_snippet").contains(F.col("value")), "value_not_in_snippet")
        .when(~suggested_context(F.col("claim_path"), F.col("source_url"), title, F.col("_text")), "context_gate_failed")
    )
    return rows.withColumn("reason", reason).drop("_url", "_text", "_title", "_official")


def snippets_supported(candidates: DataFrame, evidence: DataFrame, source_text: Column) -> DataFrame:
    """``candidates`` (.., claim_path, value, evidence_snippet, source_url or null) with ``accepted``: whether some
    evidence of the path has the very snippet (and address), the text holds it and it holds the value, case apart."""
    proof = evidence.select("claim_path", F.trim("snippet").alias("_snippet"), F.col("source_url").alias("_url"))
    known = proof.groupBy("claim_path", "_snippet").agg(F.collect_set("_url").alias("_urls"))  # addresses that state one snippet
    snippet = F.trim("evidence_snippet")
    rows = candidates.withColumn("_snippet", snippet).join(known, ["claim_path", "_snippet"], "left")
    there = F.col("_urls").isNotNull() & (F.col("source_url").isNull() | F.array_contains("_urls", F.col("source_url")))
    holds = (snippet != "") & source_text.contains(snippet) & F.lower(snippet).contains(F.lower(F.trim(F.col("value").cast("string"))))
    return rows.withColumn("accepted", F.coalesce(there & holds, F.lit(False))).drop("_snippet", "_urls")


def evidence_rows(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """An evidence row for each claim (scan_id, claim_path, source_url, snippet, and if given page_number, confidence):
    with the type, title, time, year and page of its source (one row an address). Confidence is medium unless stated."""
    given = set(claims.columns)
    page = F.coalesce("c.page_number", "s.page_number") if "page_number" in given else F.col("s.page_number")
    confidence = F.coalesce("c.confidence", F.lit("medium")) if "confidence" in given else F.lit("medium")
    rows = claims.alias("c").join(sources.alias("s"), (F.col("c.scan_id") == F.col("s.scan_id")) & (F.col("c.source_url") == F.col("s.source_url")))
    return rows.select("c.scan_id", "c.claim_path", "c.source_url", "s.source_type", "s.title", "s.retrieved_at", "s.academic_year", page.alias("page_number"), "c.snippet", confidence.alias("confidence"))


#: Lists and objects that a result always has, empty or not.
ROOTS = ("/institution", "/institution/name", "/admissions", "/programmes", "/fees", "/scholarships", "/visa", "/housing", "/contacts", "/programme_catalog", "/sources", "/evidence", "/warnings", "/run")


def _prefixes(path: Column) -> Column:
    """A path and what holds it; null for a path without parts."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    of = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(p, 1, n), "/")))
    return bound(parts, lambda p: F.when(F.size(p) > 0, of(p)))


def resolvable_paths(claims: DataFrame) -> DataFrame:
    """(scan_id, claim_path): every place that exists in a result: its claims' paths and what holds them."""
    held = claims.where("claim_path <> ''").select("scan_id", F.explode(_prefixes(F.col("claim_path"))).alias("claim_path"))
    roots = claims.select("scan_id").distinct().select("scan_id", F.explode(F.array(*map(F.lit, ROOTS))).alias("claim_path"))
    return held.union(roots).distinct()


def unresolved(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence whose path leads nowhere; slashes at its ends and doubled ones don't count.

    Places that every result has are looked up as one, the empty path. Places are as many as claims and more, whatever
    size the planner takes them for: they are sorted and merged, never sent to the driver."""
    path = F.concat(F.lit("/"), F.array_join(F.filter(F.split("claim_path", "/"), lambda p: p != ""), "/"))
    places = F.concat(F.array(F.lit("")), F.filter(F.coalesce(_prefixes(F.col("claim_path")), F.array().cast("array<string>")), lambda p: ~p.isin(*ROOTS)))
    known = claims.select(F.col("scan_id").alias("_scan"), F.explode(places).alias("_path")).distinct()
    place = bound(path, lambda p: F.when(p.isin(*ROOTS), "").otherwise(p))
    return evidence.join(known.hint("merge"), (F.col("scan_id") == F.col("_scan")) & (place == F.col("_path")), "left_anti")


def flattened(results: DataFrame, key: list[str]) -> DataFrame:
    """(key, claim_path, value, status) of every claim in nested results. A claim is a struct with ``value`` and
    ``status``; structs and arrays of structs are walked by the schema, places in arrays are part of the path."""

    def walk(at: Column, kind: T.DataType, path: Column) -> Column | None:
        if isinstance(kind, T.StructType):
            if {"value", "status"} <= set(kind.names):
                return F.array(F.struct(path.alias("claim_path"), at["value"].cast("string").alias("value"), at["status"].alias("status")))
            parts = [found for f in kind if (found := walk(at[f.name], f.dataType, F.concat(path, F.lit(f"/{f.name}")))) is not None]
            return F.concat(*parts) if parts else None
        if isinstance(kind, T.ArrayType) and walk(F.lit(None).cast(kind.elementType), kind.elementType, F.lit("")) is not None:
            each = F.transform(at, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("/"), i.cast("string"))))
            return F.coalesce(F.flatten(each), F.array().cast("array<struct<claim_path:string,value:string,status:string>>"))
        return None

    found = [f for n in results.columns if n not in key and (f := walk(F.col(n), results.schema[n].dataType, F.lit(f"/{n}"))) is not None]
    return results.select(*key, F.inline(F.concat(*found)))


def row_provenance(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Warnings about catalogue rows (scan_id, position from 0, source_url, evidence_snippet, evidence_path): the first of
    missing fields, a path outside of the row, and a path without evidence."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    names = ("source_url", "evidence_snippet", "evidence_path")
    missing = F.filter(F.array(*(F.when(blank(F.col(n)), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    place = F.concat(F.lit("/programme_catalog/"), F.col("position").cast("string"))
    proof = evidence.select("scan_id", F.col("claim_path").alias("evidence_path"), F.lit(True).alias("_proof")).distinct()
    warning = lambda message, field: F.struct(F.lit("missing_evidence").alias("code"), message.alias("message"), field.alias("field"))
    found = (
        F.when(F.size(missing) > 0, warning(F.concat(F.lit("Programme catalog row lacks required provenance fields: "), F.array_join(missing, ", ")), F.concat(place, F.lit("/name"))))
        .when(~F.col("evidence_path").startswith(F.concat(place, F.lit("/"))), warning(F.lit("Programme catalog row evidence_path must point inside the same programme_catalog row."), F.concat(place, F.lit("/evidence_path"))))
        .when(F.col("_proof").isNull(), warning(F.lit("Programme catalog row evidence_path has no matching evidence item."), F.col("evidence_path")))
    )
    out = rows.join(proof, ["scan_id", "evidence_path"], "left").withColumn("w", found).where("w is not null")
    return out.select("scan_id", "w.*", F.when(F.col("source_url") != "", F.array("source_url")).otherwise(F.array().cast("array<string>")).alias("source_urls"))
