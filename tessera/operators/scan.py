"""From captured pages to claims: the router of page categories to extractors, what supplements them, and a scan's result.

A scan's claims depend on what its earlier pages gave. That is one window for each scan and field: a supplement counts
where nothing before it has a value, since the first value that a field gets, from either, fills it.

Pages: scan_id, page_order, url, title, text, source_type (html, pdf, json, other). Defined cases: null texts are empty;
blocked pages and JSON answers are logged and give no claims here (JSON: ``json_bodies``); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import english as N
from tessera.functions import extract as X
from tessera.functions import gates as G
from tessera.functions import rules as R
from tessera.functions.text import collapsed
from tessera.operators.diagnostics import coverage

VALUES = "array<struct<value:string,snippet:string>>"
#: Claim labels and where a field's claims are in a result.
PLACES = {
    "undergraduate_application_entry": ("application entry", "/admissions/undergraduate_application_entry"),
    "application_periods": ("application deadline", "/admissions/application_periods/{}/value"),
    "english_requirements": ("english language requirement", "/admissions/english_requirements/{}/value"),
    "accepted_qualifications": ("accepted qualification", "/admissions/accepted_qualifications/{}/value"),
    "required_documents": ("required documents", "/admissions/required_documents/{}/value"),
    "programmes": ("programme", "/programmes/{}/name"),
    "fees": ("tuition/fees", "/fees/{}/value"),
    "scholarships": ("scholarship", "/scholarships/{}/value"),
    "visa": ("visa/student pass", "/visa/{}/value"),
    "housing": ("housing/accommodation", "/housing/{}/value"),
    "contacts": ("admissions contact", "/contacts/{}/value"),
}


def _one(value: Column, snippet: Column | None = None) -> Column:
    none = F.array().cast(VALUES)
    return F.when(value.isNotNull(), F.array(F.struct(value.alias("value"), (value if snippet is None else snippet).alias("snippet")))).otherwise(none)


def _event(stage: int, field: str, extractor: str, values: Column, gate: Column | None = None, reason: str = "category_route") -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), F.lit(extractor).alias("extractor"), F.lit(reason).alias("reason"), (F.lit(True) if gate is None else gate).alias("gate"), values.alias("found"))


def judged_pages(pages: DataFrame) -> DataFrame:
    """Pages with category, strategy and the context gates."""
    u, t, b = F.col("url"), F.col("title"), F.coalesce(F.col("text"), F.lit(""))
    rows = pages.select("scan_id", "page_order", "url", "title", b.alias("text"), "source_type", G.classified(u, t, b)["category"].alias("category"))
    return rows.withColumns(
        {
            "strategy": G.source_strategy(F.col("source_type"), u, t, F.col("text"), F.col("category")),
            "ug": G.undergraduate_context(u, t, F.col("text")),
            "in_fees": G.fee_context(u, t, F.col("text")),
            "in_scholarships": G.scholarship_context(u, t, F.col("text")),
            "in_contacts": G.contact_context(u, t, F.col("text")),
            "in_english": G.english_context(u, t, F.col("text")),
        }
    )


#: Fields by their bit in ``gives`` and ``filled``.
_BITS = {f: 1 << i for i, f in enumerate((*PLACES, "programme_prerequisites"))}


def _bit(field: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in _BITS.items() for x in pair))[field]


def page_events(rows: DataFrame) -> DataFrame:
    """Judged pages, of those that give claims, without their texts and with ``events``, one for each extractor that a
    page calls, by its category (stage 0), then as a supplement (stage 1); and ``gives``, the bits of the fields that
    have a value here. All of it depends on a page's content alone: what several scans share may be read once."""
    u, t, b = F.col("url"), F.col("title"), F.col("text")
    period = X.deadline(b)
    fee, contact = X.fee(u, t, b), X.contact(u, t, b)
    found = rows.withColumns(
        {
            "_periods": _one(period["value"], period["snippet"]),
            "_english": _one(N.english_requirement(b)["value"]),
            "_fees": _one(fee),
            "_scholarships": _one(X.keyword_sentence(b, "Scholarships?|Financial aid")),
            "_contacts": _one(contact, X.contact_snippet(b, contact)),
            "_programmes": F.transform(X.programme_names(b), lambda n: F.struct(n.alias("value"), n.alias("snippet"))).cast(VALUES),
        }
    )
    documents = _one(X.keyword_sentence(b, "Required documents?|Documents required"))
    need = X.prerequisite(b)
    routes = {
        ("undergraduate_admissions",): [_event(0, "application_periods", "extract_deadline", F.col("_periods")), _event(0, "undergraduate_application_entry", "source_url_from_application_period", F.when(F.size("_periods") > 0, _one(u, F.coalesce(t, u))).otherwise(F.array().cast(VALUES))), _event(0, "required_documents", "extract_required_document", documents)],
        ("international_requirements",): [_event(0, "english_requirements", "extract_english_requirement", F.col("_english"), F.col("in_english"))],
        ("application_deadlines",): [_event(0, "application_periods", "extract_deadline", F.col("_periods"))],
        ("accepted_qualifications",): [_event(0, "accepted_qualifications", "extract_accepted_qualification", _one(N.accepted_qualification(b)))],
        ("programme_list", "programme_prerequisites"): [_event(0, "programmes", "extract_programmes", F.col("_programmes")), _event(0, "programme_prerequisites", "extract_prerequisite", _one(F.when(need.isNotNull(), F.lit("Mathematics required")), need))],
        ("fees",): [_event(0, "fees", "extract_fee", F.col("_fees"), F.col("in_fees"))],
        ("scholarships",): [_event(0, "scholarships", "extract_scholarship", F.col("_scholarships"), F.col("in_scholarships"))],
        ("visa",): [_event(0, "visa", "extract_visa", _one(X.keyword_sentence(b, "Visa|Student pass|Immigration")))],
        ("housing",): [_event(0, "housing", "extract_housing", _one(X.keyword_sentence(b, "Housing|Accommodation|Residence")))],
        ("contact",): [_event(0, "contacts", "extract_contact", F.col("_contacts"), F.col("in_contacts"))],
    }
    extra = [
        _event(1, "application_periods", "extract_deadline", F.col("_periods"), reason="core_supplement"),
        _event(1, "english_requirements", "extract_english_requirement", F.col("_english"), F.col("in_english"), "core_supplement"),
        _event(1, "fees", "extract_fee", F.col("_fees"), F.col("in_fees"), "core_supplement"),
        _event(1, "scholarships", "extract_scholarship", F.col("_scholarships"), F.col("in_scholarships"), "core_supplement"),
        _event(1, "contacts", "extract_contact", F.col("_contacts"), F.col("in_contacts"), "core_supplement"),
        _event(1, "programmes", "extract_programmes", F.col("_programmes"), reason="core_supplement"),
    ]
    nothing = F.slice(F.array(extra[0]), 1, 0)
    routed = nothing
    for categories, events in routes.items():
        routed = F.when(F.col("category").isin(*categories), F.array(*events)).otherwise(routed)
    added = F.when((F.col("category") != "irrelevant") & F.col("ug"), F.array(*extra)).otherwise(nothing)
    usable = (F.col("strategy") != "blocked_or_challenge") & (F.col("source_type") != "json")
    made = found.where(usable).withColumn("events", F.concat(routed, added)).drop(*(c for c in found.columns if c.startswith("_")), "text")
    bits = F.aggregate("events", F.lit(0), lambda a, e: a.bitwiseOR(F.when(e["gate"] & (F.size(e["found"]) > 0), _bit(e["field"])).otherwise(0)))
    return made.withColumn("gives", bits)


def filled_before(rows: DataFrame) -> DataFrame:
    """Pages (scan_id, page_order, gives) with ``filled``: the bits of the fields that earlier pages of the scan gave."""
    before = Window.partitionBy("scan_id").orderBy("page_order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("filled", F.coalesce(F.bit_or("gives").over(before), F.lit(0)))


def attempts(pages: DataFrame) -> DataFrame:
    """The log of extractions (write it once if several tables are made of it): scan_id, page_order, url, k (place in the page), field, extractor, status (extracted,
    no_match, skipped), reason, record_count, and what was found."""
    return logged(filled_before(page_events(judged_pages(pages))))


def logged(rows: DataFrame) -> DataFrame:
    """The log of pages with events, of which ``filled`` fields have a value from earlier pages (see ``attempts``)."""
    has = lambda e: e["gate"] & (F.size(e["found"]) > 0)
    earlier = lambda e, i: F.exists(F.slice("events", 1, i), lambda x: (x["field"] == e["field"]) & has(x))
    each = F.transform("events", lambda e, i: F.struct(e.alias("e"), has(e).alias("has"), ((F.col("filled").bitwiseAND(_bit(e["field"])) != 0) | earlier(e, i)).alias("filled")))
    events = rows.select("scan_id", "page_order", "url", F.posexplode(each).alias("k", "x")).select("scan_id", "page_order", "url", "k", "x.e.*", "x.has", "x.filled")
    single = (F.col("stage") == 1) | (F.col("field") == "undergraduate_application_entry")
    entry = (F.col("field") == "undergraduate_application_entry") & ~F.col("has")
    status = F.when(entry, "skipped").when(single & F.col("filled"), "skipped").when(~F.col("gate"), "skipped").when(F.col("has"), "extracted").otherwise("no_match")
    reason = F.when(entry, "requires_application_period").when(single & F.col("filled"), "existing_value").when(~F.col("gate"), "context_gate_failed").otherwise(F.col("reason"))
    out = events.withColumns({"status": status, "reason": reason})
    return out.select("scan_id", "page_order", "url", "k", "field", "extractor", "status", "reason", F.when(F.col("status") == "extracted", F.size("found")).otherwise(0).alias("record_count"), "found")


def claims(log: DataFrame) -> DataFrame:
    """Claims of a log: scan_id, field, claim_path, label, value, snippet, source_url. Paths are numbered in capture order.
    A prerequisite goes to the first programme of its page, else to the scan's first one if an earlier page has one, else
    to the accepted qualifications."""
    found = log.where("status = 'extracted'").select("scan_id", "page_order", "k", "field", "url", F.posexplode("found").alias("i", "c")).select("scan_id", "page_order", "k", "i", "field", F.col("url").alias("source_url"), "c.*")
    order = ["page_order", "k", "i"]
    before = Window.partitionBy("scan_id").orderBy("page_order").rangeBetween(Window.unboundedPreceding, -1)
    programme = F.when(F.col("field") == "programmes", 1).otherwise(0)
    found = found.withColumns({"_earlier": F.coalesce(F.sum(programme).over(before), F.lit(0)), "_here": F.sum(programme).over(Window.partitionBy("scan_id", "page_order"))})
    need = F.col("field") == "programme_prerequisites"
    home = F.when(need & (F.col("_here") > 0), F.col("_earlier")).when(need & (F.col("_earlier") > 0), 0)
    found = found.withColumns({"_home": home, "field": F.when(need & home.isNull(), "accepted_qualifications").otherwise(F.col("field"))})
    nth = (F.row_number().over(Window.partitionBy("scan_id", "field", "_home").orderBy(*order)) - 1).cast("string")
    parts = {f: (label, *place.partition("{}")) for f, (label, place) in PLACES.items()}
    by_field = lambda k: F.create_map(*(F.lit(x) for f, p in parts.items() for x in (f, p[k])))[F.col("field")]
    found = found.withColumns({"_nth": nth, "_label": by_field(0), "_head": by_field(1), "_tail": by_field(3)})
    prerequisite = F.concat(F.lit("/programmes/"), F.col("_home").cast("string"), F.lit("/prerequisites/"), F.col("_nth"), F.lit("/value"))
    path = F.when(F.col("_home").isNotNull(), prerequisite).when(F.col("_tail") == "", F.col("_head")).otherwise(F.concat("_head", "_nth", "_tail"))
    label = F.when(F.col("_home").isNotNull() | (F.col("value") == "Mathematics required"), "mathematics prerequisite").otherwise(F.col("_label"))
    return found.select("scan_id", "field", path.alias("claim_path"), label.alias("label"), collapsed(F.col("value")).alias("value"), "snippet", "source_url")


def scan_coverage(scans: DataFrame, made: DataFrame) -> DataFrame:
    """Coverage of core fields for every scan (scan_id), also those without claims."""
    known = made.select("scan_id", "field", F.lit(True).alias("known"))
    none = scans.select("scan_id", F.lit(R.CORE_FIELDS[0]).alias("field"), F.lit(False).alias("known"))
    return coverage(known.unionByName(none))


def run_warnings(covered: DataFrame, pages: DataFrame) -> DataFrame:
    """Warnings of whole scans: core fields that are missing, and portals and blocked pages with their addresses in
    capture order. covered: scan_id, missing; pages: scan_id, page_order, url, strategy."""
    gaps = covered.where("missing <> ''").select("scan_id", F.lit("Some core undergraduate admissions fields were not found; review coverage.missing.").alias("message"), F.lit("/run/config/coverage").alias("field"), F.array().cast("array<string>").alias("source_urls"))
    shut = pages.where(F.col("strategy").isin("blocked_or_challenge", "application_portal")).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_order", "url"))), lambda p: p["url"]).alias("source_urls"))
    shut = shut.select("scan_id", F.lit("Some sources look like application portals or bot/challenge pages; crawler will not bypass restricted systems.").alias("message"), F.lit("/run/config/source_strategy").alias("field"), "source_urls")
    return gaps.unionByName(shut).withColumn("code", F.lit("needs_manual_check"))


def scanned(pages: DataFrame) -> dict[str, DataFrame]:
    """The tables of a scan's result: pages with their category and strategy, the log, claims, coverage and warnings."""
    judged = judged_pages(pages)
    log = attempts(pages)
    made = claims(log)
    covered = scan_coverage(pages.select("scan_id").distinct(), made)
    return {"pages": judged.select("scan_id", "page_order", "url", "category", "strategy"), "attempts": log.drop("found"), "claims": made, "coverage": covered, "warnings": run_warnings(covered, judged)}
