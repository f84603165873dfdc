"""The Markdown evidence report of scans: diagnostics first, then facts with their evidence, never a verdict.

Every line is a row with its section and place, so sections come from joins and counts; a report is the lines of one scan
in order, bounded by that scan's result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.rules import CORE_FIELDS

#: Headings of facts, and the field whose claims stand below each.
FACTS = {
    "application_periods": "Application periods",
    "english_requirements": "English requirements",
    "required_documents": "Required documents",
    "accepted_qualifications": "Accepted qualifications",
    "programmes": "Programmes",
    "fees": "Fees",
    "scholarships": "Scholarships",
    "visa": "Visa / student pass",
    "housing": "Housing",
    "contacts": "Contacts",
}
SECTIONS = ("Summary", "Core Field Coverage", "Source strategy", "Extraction diagnostics", "Missing reasons", "Discovered categories", "Facts", "Warnings / Manual check", "Sources", "Evidence appendix")


def _lines(df: DataFrame, section: str, text: Column, *order) -> DataFrame:
    return df.select("scan_id", F.lit(SECTIONS.index(section)).alias("section"), F.array(*(o.cast("string") if isinstance(o, Column) else F.lit(str(o)) for o in order)).alias("place"), text.alias("line"))


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 12, "0")


def _counted(rows: DataFrame, by: str, section: str, title: str) -> DataFrame:
    """One line with the counts of a column, by name."""
    counts = rows.groupBy("scan_id", by).agg(F.count("*").alias("n")).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), "n"))).alias("c"))
    shown = F.array_join(F.transform("c", lambda x: F.concat(F.lit("`"), x["k"], F.lit("`: "), x["n"].cast("string"))), ", ")
    return _lines(counts, section, F.concat(F.lit(f"- {title}: "), shown), title)


def report_lines(scans: DataFrame, pages: DataFrame, attempts: DataFrame, claims: DataFrame, coverage: DataFrame, warnings: DataFrame, sources: DataFrame, reasons: DataFrame) -> DataFrame:
    """(scan_id, section, place, line). scans: scan_id, input_url, retrieved_at, confidence; pages: page_order, url,
    title, category, score, strategy; attempts: status; claims: field, claim_path, label, value, snippet, source_url;
    coverage: found, missing; warnings: position, code, field, message; sources: position, source_url, title,
    source_type, retrieved_at; reasons: field, canonical_reason. All by scan_id."""
    count = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    head = scans.join(count(sources, "n_sources"), "scan_id", "left").join(count(claims, "n_evidence"), "scan_id", "left")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    summary = ((text("- Input URL: ", F.col("input_url"))), text("- Retrieved at: ", F.col("retrieved_at")), text("- Sources captured: ", number("n_sources")), text("- Evidence items: ", number("n_evidence")), text("- Overall confidence: ", F.col("confidence")), F.lit("- Admissions verdict: not provided; this report is evidence only."))
    parts = [_lines(head, "Summary", line, i) for i, line in enumerate(summary)]

    total = str(len(CORE_FIELDS))
    missing = F.when(F.col("missing") == "", "none").otherwise(F.replace("missing", F.lit(","), F.lit(", ")))
    note = "- Note: coverage reports field completeness; overall confidence reports evidence quality for extracted claims."
    parts += [_lines(coverage, "Core Field Coverage", line, i) for i, line in enumerate((text("- Found: ", F.col("found").cast("string"), "/" + total), text("- Missing: ", missing), F.lit(note)))]
    parts.append(_counted(pages, "strategy", "Source strategy", "Strategies"))
    parts.append(_counted(attempts, "status", "Extraction diagnostics", "Attempts"))
    parts.append(_lines(reasons, "Missing reasons", text("- `", F.col("field"), "`: ", F.col("canonical_reason")), F.col("field")))

    found = pages.where(F.col("category").isNotNull())
    name = F.coalesce("title", "url")
    parts.append(_lines(found, "Discovered categories", text("- `", F.col("category"), "` — ", name, " (", F.col("url"), "), score ", F.col("score").cast("string"), "."), _padded(F.col("page_order"))))

    entry = claims.where("field = 'undergraduate_application_entry'")
    said = entry.select("scan_id", F.col("value").alias("_entry")).join(scans.select("scan_id"), "scan_id", "right")
    parts.append(_lines(said, "Facts", text("- Undergraduate application entry: ", F.coalesce("_entry", F.lit("unknown"))), "00", ""))
    nth = F.regexp_extract("claim_path", r"^[^0-9]*/([0-9]+)", 1).cast("int")
    for k, (field, title) in enumerate(FACTS.items(), 1):
        rank = f"{k:02d}"
        heads = scans if field != "programmes" else claims.where("field = 'programmes'").select("scan_id").distinct()
        parts.append(_lines(heads, "Facts", F.lit(f"### {title}"), rank, ""))
        own = claims.where(F.col("field") == field)
        if field == "programmes":
            parts.append(_lines(own, "Facts", text("- ", F.col("value"), " (source: ", F.col("source_url"), ")"), rank, _padded(nth), ""))
            needs = claims.where("field = 'programme_prerequisites'")
            parts.append(_lines(needs, "Facts", text("  - ", F.col("label"), ": ", F.col("value")), rank, _padded(nth), F.lit("p"), F.col("claim_path")))
        else:
            parts.append(_lines(scans.join(own.select("scan_id").distinct(), "scan_id", "left_anti"), "Facts", F.lit("- unknown"), rank, "0"))
            parts.append(_lines(own, "Facts", text("- ", F.col("label"), ": ", F.col("value")), rank, _padded(nth), ""))
        parts.append(_lines(own, "Facts", text("  - evidence: ", F.col("source_url"), " — ", F.col("snippet")), rank, _padded(nth), F.lit("e")))

    parts.append(_lines(warnings, "Warnings / Manual check", text("- `", F.col("code"), "` ", F.coalesce("field", F.lit("")), ": ", F.col("message")), _padded(F.col("position"))))
    parts.append(_lines(scans.join(warnings.select("scan_id").distinct(), "scan_id", "left_anti"), "Warnings / Manual check", F.lit("- None"), "0"))
    parts.append(_lines(sources, "Sources", text("- [", F.coalesce("title", "source_url"), "](", F.col("source_url"), ") — `", F.col("source_type"), "` retrieved ", F.col("retrieved_at")), _padded(F.col("position"))))
    parts.append(_lines(claims, "Evidence appendix", text("- `", F.col("claim_path"), "` ", F.col("source_url"), ": ", F.col("snippet")), F.col("claim_path")))
    return reduce(DataFrame.unionByName, parts)


def markdown(lines: DataFrame) -> DataFrame:
    """(scan_id, body): lines by section, each section under its heading, with a blank line after it; sections without
    lines are left out."""
    titles = F.create_map(*(F.lit(x) for i, s in enumerate(SECTIONS) for x in (i, s)))
    own = Window.partitionBy("scan_id", "section").orderBy("place", "line")
    numbered = lines.withColumn("n", F.row_number().over(own))
    sections = numbered.groupBy("scan_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = sections.select("scan_id", "section", F.concat(F.lit("## "), titles[F.col("section")], F.lit("\n\n"), "text", F.lit("\n")).alias("text"))
    body = whole.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]).alias("parts"))
    return body.select("scan_id", F.concat(F.lit("# University Admissions Evidence Report\n\n"), F.array_join("parts", "\n")).alias("body"))
