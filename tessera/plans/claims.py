"""Queries over extracted values, claims, evidence, diagnostics, catalogues and differences.

Inputs are derived from the relational tables by the same expressions in both engines; expectations come from the
columns, not from reading the derived texts again.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import english as N
from tessera.functions import extract as X
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import catalogue as K
from tessera.operators import crawl as C
from tessera.operators import diagnostics as D
from tessera.operators import evidence as E
from tessera.operators import incremental as I
from tessera.plans.base import case, query, table, text, values

_DAY = "strftime({}, '%-d %B %Y')"


def _day(col: str) -> str:
    return f"date_format({col}, 'd MMMM yyyy')"


# Extractors -----------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {_DAY.format('o_orderdate')} AS value, 'Deadline: ' || {_DAY.format('o_orderdate')} AS snippet, CAST(o_orderdate AS DATE) AS day FROM orders")
def deadline_extract(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"'Please note. Deadline: ' || {_day('o_orderdate')} || '. More follows.' AS body")
    x = X.deadline(F.col("body"))
    return d.select("o_orderkey", x["value"].alias("value"), x["snippet"].alias("snippet"), X.typed_date(x["deadline"]).alias("day"))


@query(f"SELECT l_orderkey, l_linenumber, {_DAY.format('l_shipdate')} AS open_date, {_DAY.format('l_shipdate + INTERVAL 30 DAY')} AS deadline, {case('l_linenumber', 'NULL', text('main round'))} AS round FROM lineitem")
def date_parse(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{case('l_linenumber', text('Application period: '), text('Main round, from '))} || {_day('l_shipdate')} || ' to ' || {_day('l_shipdate + INTERVAL 30 DAY')} AS body")
    x = X.application_dates(F.col("body"))
    return d.select("l_orderkey", "l_linenumber", x["open_date"].alias("open_date"), x["deadline"].alias("deadline"), F.lower(x["round"]).alias("round"))


_CODES = ("SGD", "USD", "HKD", "S$", "US$")


@query(f"SELECT o_orderkey, {case('o_orderkey', *map(text, ('SGD', 'USD', 'HKD', 'SGD', 'USD')))} AS currency, CAST(floor(o_totalprice) AS BIGINT) AS amount, 'non-local' AS student_group, 'per year' AS billing_period, {case('o_orderkey', text('tuition'), text('miscellaneous_fee'), text('fee'))} AS fee_type FROM orders")
def money_parse(spark, sf_dir):
    kind = case("o_orderkey", text("Tuition fees are "), text("Miscellaneous charges are "), text("Fees are "))
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"'Read this first. ' || {kind} || {case('o_orderkey', *map(text, _CODES))} || ' ' || CAST(floor(o_totalprice) AS BIGINT) || '.75 per year for international students. Apply now.' AS body")
    m = F.get(X.money(F.col("body")), 0)
    return d.select("o_orderkey", *(m[c].alias(c) for c in ("currency", "amount", "student_group", "billing_period", "fee_type")))


@query("SELECT o_orderkey, 'Tuition fees are SGD ' || CAST(floor(o_totalprice) AS BIGINT) || ' per year for international students.' AS snippet FROM orders")
def fee_extract(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'Welcome to campus. Tuition fees are SGD ' || CAST(floor(o_totalprice) AS BIGINT) || ' per year for international students. Bye.' AS body")
    return d.select("o_orderkey", X.fee_snippet(F.col("body")).alias("snippet"))


#: Requirements by kind: text, then test, overall score and components of each score that is read.
_ENGLISH = (
    ("English language requirements: an overall band of 7 in the IELTS, with no subtest below 6.5.", (("IELTS", "7", "minimum_component=6.5"),)),
    ("IELTS minimum 6.0 overall; TOEFL iBT (minimum of 90), writing 25 or PTE Academic at least 55. Fees apply.", (("IELTS", "6.0", ""), ("TOEFL iBT", "90", "writing=25"), ("PTE Academic", "55", ""))),
    ("English and Applied Linguistics - BA (Hons) Bachelor of Science. Select a Programme Quick Links. IELTS 6.5 overall", ()),
    ("Applicants may submit IELTS or TOEFL results.", ()),
    ("English proficiency: applicants whose medium of instruction was English are exempt.", ((None, None, ""),)),
    ("IELTS: waived for speakers of English.", ((None, None, ""),)),
    ("Scores of tests such as C1 Advanced with grade B and IELTS of at least 6.5 for each component", (("IELTS", "6.5", ""),)),
    ("No requirement here.", ()),
)
_TESTS = [(i, *t) for i, (_, tests) in enumerate(_ENGLISH) for t in tests]


@query(f"SELECT p_partkey, test_name, overall_score, components FROM part JOIN {values(_TESTS, 'kind, test_name, overall_score, components')} AS r ON p_partkey % 8 = kind")
def english_scores(spark, sf_dir):
    kinds = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_ENGLISH)], "kind int, body string")
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 8 AS INT) AS kind").join(F.broadcast(kinds), "kind").withColumn("r", N.english_requirement(F.col("body")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("t.component_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return d.select("p_partkey", F.explode("r.tests").alias("t")).select("p_partkey", "t.test_name", "t.overall_score", shown.alias("components"))


_SNIPPETS = (("English Language Centre", True), ("a bachelor b bachelor c", True), ("a programme b programme c programme d programme e programme f", True), ("IELTS 6.5 for one bachelor degree", False))


@query(f"SELECT p_partkey, listed FROM part JOIN {values([(i, b) for i, (_, b) in enumerate(_SNIPPETS)], 'kind, listed')} AS r ON p_partkey % 4 = kind")
def english_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{case('p_partkey', *(text(t) for t, _ in _SNIPPETS))} AS body")
    return d.select("p_partkey", N.looks_like_list(F.col("body")).alias("listed"))


_QUALIFICATIONS = (("Note. Accepted qualifications  include GCE. More", "Accepted qualifications  include GCE."), ("IB Diploma is accepted here. A-level too is accepted.", "IB Diploma is accepted here."), ("Qualification accepted: HKDSE. IB Diploma accepted.", "Qualification accepted: HKDSE."), ("IB Diploma only.", None))


@query(f"SELECT p_partkey, value FROM part JOIN {values([(i, v and v.replace('  ', ' ')) for i, (_, v) in enumerate(_QUALIFICATIONS)], 'kind, value')} AS r ON p_partkey % 4 = kind")
def qualification_extract(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{case('p_partkey', *(text(t) for t, _ in _QUALIFICATIONS))} AS body")
    return d.select("p_partkey", N.accepted_qualification(F.col("body")).alias("value"))


@query("SELECT p_partkey, 'Bachelor of ' || p_name AS name, 1 AS names FROM part")
def programme_names(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "'Our Bachelor of ' || p_name || ' requires Mathematics. The bachelor of ' || p_name || ' needs Art.' AS body")
    names = X.programme_names(F.col("body"))
    return d.select("p_partkey", F.get(names, 0).alias("name"), F.size(names).alias("names"))


@query(
    r"SELECT doc_id, CASE WHEN NOT contains(lower(substr(text, 1, 1000)), 'privacy') AND NOT contains(lower(substr(text, 1, 1000)), '/contact-us/form') AND NOT contains(lower(substr(text, 1, 1000)), 'personal information collection statement') "
    r"THEN coalesce(nullif(regexp_extract(text, '([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,})', 1), ''), nullif(trim(regexp_extract(text, '(?i)(?:phone|tel)[:\s]+([+()0-9][+()0-9\-\s]{5,})', 1)), '')) END AS contact FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Tel: +65 1234 (5678)' ELSE '' END AS text FROM documents)"
)
def contact_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text || CASE WHEN doc_id % 5 = 0 THEN ' Tel: +65 1234 (5678)' ELSE '' END AS text")
    return d.select("doc_id", X.contact(F.lit("https://e.edu/contact"), F.lit("Contact"), F.col("text")).alias("contact"))


@query("SELECT p_partkey, 'Scholarship number ' || p_size || ' is open.' AS scholarship, 'Visa for ' || p_name || ' holders.' AS visa, 'requires Mathematics at level ' || p_size || '.' AS prerequisite, 'Scholarship number ' || p_size || ' is open.' AS sentence FROM part")
def snippet_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "'Hello there. Scholarship number ' || p_size || ' is open. Visa for ' || p_name || ' holders. A ' || p_name || ' degree requires Mathematics at level ' || p_size || '. End.' AS body")
    b = F.col("body")
    return d.select("p_partkey", X.keyword_sentence(b, "scholarship").alias("scholarship"), X.keyword_sentence(b, "visa").alias("visa"), F.trim(X.prerequisite(b)).alias("prerequisite"), T.sentence_with(b, F.lit("number")).alias("sentence"))


@query("SELECT o_orderkey, year(o_orderdate) || '/' || (year(o_orderdate) + 1) AS academic_year FROM orders")
def academic_year(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{case('o_orderkey', text('Academic year: '), text('For AY '))} || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || ' only' AS body")
    return d.select("o_orderkey", T.academic_year(F.col("body")).alias("academic_year"))


# Claims and evidence --------------------------------------------------------------------------------------------------

_STATUS = case("o_orderkey", "'known'", "'known'", "'unknown'", "'known'", "'needs_manual_check'")
_CLAIMS = f"(SELECT o_custkey AS scan_id, 'p' || o_orderkey AS claim_path, o_orderpriority AS label, o_orderstatus AS value, {_STATUS} AS status FROM orders)"
#: Evidence for two thirds of the orders; that of the others names claims which don't exist.
_PATH = "CASE WHEN l_orderkey % 3 = 0 THEN 'q' ELSE 'p' END || l_orderkey"
_EVIDENCE = f"(SELECT l_suppkey AS supp, o_custkey AS scan_id, {_PATH} AS claim_path, 'https://s' || l_suppkey || '.edu' AS source_url, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS scan_id", "'p' || o_orderkey AS claim_path", "o_orderpriority AS label", "o_orderstatus AS value", f"{_STATUS} AS status")


def _evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr("l_suppkey AS supp", "o_custkey AS scan_id", f"{_PATH} AS claim_path", "'https://s' || l_suppkey || '.edu' AS source_url", "l_linenumber")


@query(f"SELECT scan_id, claim_path, value FROM {_CLAIMS} AS c WHERE status = 'known' AND NOT EXISTS (SELECT 1 FROM {_EVIDENCE} AS e WHERE e.scan_id = c.scan_id AND e.claim_path = c.claim_path)")
def evidence_missing_anti(spark, sf_dir):
    return E.without_evidence(_claims(spark, sf_dir), _evidence(spark, sf_dir)).select("scan_id", "claim_path", "value")


@query(f"SELECT claim_path, l_linenumber FROM {_EVIDENCE} AS e WHERE NOT EXISTS (SELECT 1 FROM {_CLAIMS} AS c WHERE c.status = 'known' AND e.scan_id = c.scan_id AND e.claim_path = c.claim_path)")
def evidence_dangling_anti(spark, sf_dir):
    return E.dangling(_evidence(spark, sf_dir), _claims(spark, sf_dir).where("status = 'known'")).select("claim_path", "l_linenumber")


@query(f"SELECT c.scan_id, lower(label) AS label, count(DISTINCT lower(trim(value))) AS values, coalesce(array_to_string(list_sort(list_distinct(list(e.source_url) FILTER (e.source_url IS NOT NULL))), ','), '') AS source_urls FROM {_CLAIMS} AS c LEFT JOIN {_EVIDENCE} AS e ON c.scan_id = e.scan_id AND c.claim_path = e.claim_path WHERE status = 'known' GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(value))) > 1")
def conflicts(spark, sf_dir):
    return E.conflicts(_claims(spark, sf_dir), _evidence(spark, sf_dir))


@query("SELECT o_orderkey, CAST(year(o_orderdate) + 1 AS INT) AS latest_year FROM orders WHERE year(o_orderdate) + 1 < 1997")
def stale_sources(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "year(o_orderdate) || '/' || (year(o_orderdate) + 1) AS academic_year")
    return E.stale_sources(d, 1997).select("o_orderkey", "latest_year")


@query(f"SELECT claim_path, l_linenumber, source_url FROM {_EVIDENCE} WHERE supp IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0)")
def non_official(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sources = s.select(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".edu")).alias("source_url"), (F.col("n_regionkey") != 0).alias("is_official"))
    return E.non_official_support(_evidence(spark, sf_dir), sources).select("claim_path", "l_linenumber", "source_url")


@query("SELECT code, field, min(l_linenumber + 10 * l_orderkey) AS first_position FROM (SELECT l_returnflag AS code, l_suppkey % 7 AS field, l_orderkey, l_linenumber FROM lineitem) GROUP BY code, field")
def warning_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS code", "l_suppkey % 7 AS field", "l_linenumber + 10 * l_orderkey AS first_position")
    return E.first_of_each(d, ["code", "field"], ["first_position"])


@query(f"SELECT c_custkey AS scan_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 IN (0, 1)) THEN 'low' WHEN c_custkey IN (SELECT scan_id FROM {_EVIDENCE}) THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def confidence_rollup(spark, sf_dir):
    code = case("o_orderkey", "'conflict'", "'missing_evidence'", *["'stale_page'"] * 9)
    warnings = table(spark, sf_dir, "orders").selectExpr("o_custkey AS scan_id", f"{code} AS code")
    return E.overall_confidence(warnings, _evidence(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scan_id")))


#: Suggested facts by kind: claim path, value, snippet, confidence, and the reason that refuses it.
_SUGGESTED = (
    ("admissions.fees", "SGD 100", "fee is SGD 100", 0.9, None),
    ("admissions.fees", "SGD 100", "fee is SGD 100", 1.5, "malformed_candidate"),
    (None, "SGD 100", "fee is SGD 100", 0.9, "malformed_candidate"),
    ("admissions.nothing", "SGD 100", "fee is SGD 100", 0.1, "low_confidence"),
    ("admissions.nothing", "SGD 100", "fee is SGD 100", 0.2, "claim_path_not_allowed"),
    ("admissions.fees", "SGD 100", "no such text", 0.9, "snippet_not_found"),
    ("admissions.fees", "SGD 200", "fee is SGD 100", 0.9, "value_not_in_snippet"),
    ("programme_catalog[].name", "SGD 100", "fee is SGD 100", 0.9, "context_gate_failed"),
    ("admissions.scholarships", "SGD", "SGD 100", 0.9, "context_gate_failed"),
)
_SUGGESTED_ROWS = values([(i, r[4]) for i, r in enumerate(_SUGGESTED)], "kind, reason")


@query(
    f"SELECT o_orderkey, CASE WHEN reason IN ('malformed_candidate', 'low_confidence', 'claim_path_not_allowed') THEN reason WHEN o_orderkey % 7 = 0 THEN 'source_not_captured' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'source_not_official' ELSE reason END AS reason FROM orders JOIN {_SUGGESTED_ROWS} AS r ON o_orderkey % {len(_SUGGESTED)} = kind"
)
def claim_validator_reason(spark, sf_dir):
    kinds = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(_SUGGESTED)], "kind int, claim_path string, value string, evidence_snippet string, confidence double")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"CAST(o_orderkey % {len(_SUGGESTED)} AS INT) AS kind", "'https://' || CASE WHEN o_orderkey % 11 = 0 THEN 'other.org' ELSE 'www.example.edu' END || '/admissions/undergraduate/fees/' || o_orderkey AS source_url")
    captured = orders.where("o_orderkey % 7 <> 0").selectExpr("source_url", "'The application fee is SGD 100.' AS text", "'Fees' AS title", "CASE WHEN o_orderkey % 3 > 0 OR o_orderkey % 5 = 0 THEN o_orderkey % 5 <> 0 END AS is_official")
    suggested = orders.join(F.broadcast(kinds), "kind").withColumn("source_title", F.lit(None).cast("string"))
    return E.suggestions_judged(suggested, captured, lambda u: U.is_allowed(u, "www.example.edu", "example.edu")).select("o_orderkey", "reason")


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AND (o_orderkey % 4 <> 3 OR o_orderkey % 5 = 1) AS accepted FROM orders")
def legacy_claim_semi(spark, sf_dir):
    """Snippets word for word in evidence of the path: with the address or without, case apart in the value only."""
    o = table(spark, sf_dir, "orders")
    snippet = case("o_orderkey", text(" Fee is SGD 5 "), text("Fee is SGD 5"), text("Fee is SGD 6"), text(""), text("fee is sgd 5"))
    candidates = o.selectExpr("o_orderkey", "'p' || o_orderkey AS claim_path", "' sgd 5' AS value", f"{snippet} AS evidence_snippet", "CASE WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 4 = 3 THEN 'https://b' ELSE 'https://a' END AS source_url")
    evidence = o.selectExpr("'p' || o_orderkey AS claim_path", "'Fee is SGD 5' AS snippet", "'https://a' AS source_url")
    return E.snippets_supported(candidates, evidence, F.lit("The Fee is SGD 5 a year.")).select("o_orderkey", "accepted")


@query("SELECT l_orderkey AS scan_id, '/fees/' || l_linenumber || '/value' AS claim_path, 'https://s' || l_suppkey AS source_url, CASE WHEN l_suppkey % 2 = 0 THEN 'pdf' ELSE 'html' END AS source_type, 'T' || l_suppkey AS title, CASE WHEN l_linenumber = 1 THEN 9 WHEN l_suppkey % 2 = 0 THEN 3 END AS page_number, CASE WHEN l_linenumber = 2 THEN 'high' ELSE 'medium' END AS confidence FROM lineitem")
def evidence_built(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    claims = lines.selectExpr("l_orderkey AS scan_id", "'/fees/' || l_linenumber || '/value' AS claim_path", "'https://s' || l_suppkey AS source_url", "'x' AS snippet", "CASE WHEN l_linenumber = 1 THEN 9 END AS page_number", "CASE WHEN l_linenumber = 2 THEN 'high' END AS confidence")
    sources = lines.selectExpr("l_orderkey AS scan_id", "'https://s' || l_suppkey AS source_url", "CASE WHEN l_suppkey % 2 = 0 THEN 'pdf' ELSE 'html' END AS source_type", "'T' || l_suppkey AS title", "'2026' AS retrieved_at", "CAST(NULL AS STRING) AS academic_year", "CASE WHEN l_suppkey % 2 = 0 THEN 3 END AS page_number").distinct()
    return E.evidence_rows(claims, sources).select("scan_id", "claim_path", "source_url", "source_type", "title", "page_number", "confidence")


@query("SELECT o_orderkey, o_orderkey % 6 AS kind FROM orders WHERE o_orderkey % 6 IN (3, 4)")
def claim_paths_resolve(spark, sf_dir):
    """Evidence that points to a claim, its list, its object, another place, beyond the list, and to an empty list."""
    o = table(spark, sf_dir, "orders")
    path = case("o_orderkey", text("/fees/0/value"), text("fees//0/"), text("/admissions/required_documents"), text("/fees/0/values"), text("/fees/1/value"), text("/programmes"))
    claims = o.selectExpr("o_orderkey AS scan_id", "explode(array('/fees/0/value', '/admissions/required_documents/0/value')) AS claim_path")
    return E.unresolved(o.selectExpr("o_orderkey AS scan_id", "o_orderkey", "o_orderkey % 6 AS kind", f"{path} AS claim_path"), claims).select("o_orderkey", "kind")


@query("SELECT o_orderkey AS scan_id, unnest(['/institution/name', '/admissions/periods/0/value', '/admissions/periods/1/value', '/fees/0/value']) AS claim_path, unnest([o_clerk, o_orderstatus, NULL, CAST(o_shippriority AS VARCHAR)]) AS value, unnest(['known', 'known', 'unknown', 'known']) AS status FROM (SELECT *, 'c' || o_custkey AS o_clerk, 7 AS o_shippriority FROM orders)")
def claims_flatten(spark, sf_dir):
    claim = lambda value, status="known": F.struct(value.cast("string").alias("value"), F.lit(status).alias("status"))
    period = lambda value, status: F.struct(F.lit("period").alias("label"), claim(value, status).alias("value"))
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.struct(claim(F.concat(F.lit("c"), "o_custkey")).alias("name"), F.lit(1).alias("rank")).alias("institution"),
        F.struct(F.array(period(F.col("o_orderstatus"), "known"), period(F.lit(None), "unknown")).alias("periods"), F.lit(None).cast("array<struct<value:struct<value:string,status:string>>>").alias("tests")).alias("admissions"),
        F.array(F.struct(F.struct(F.lit(7).alias("value"), F.lit("known").alias("status")).alias("value"))).alias("fees"),
        F.array(F.lit("note")).alias("notes"),
    )
    return E.flattened(d, ["scan_id"])


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'Programme catalog row lacks required provenance fields: source_url, evidence_snippet' WHEN 2 THEN 'Programme catalog row evidence_path must point inside the same programme_catalog row.' WHEN 3 THEN 'Programme catalog row evidence_path has no matching evidence item.' ELSE 'Programme catalog row lacks required provenance fields: evidence_path' END AS message, "
    "'/programme_catalog/' || p_size || CASE p_partkey % 5 WHEN 2 THEN '/evidence_path' ELSE '/name' END AS field FROM part WHERE p_partkey % 5 > 0"
)
def catalog_provenance(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = "'/programme_catalog/' || p_size || '/name'"
    rows = p.selectExpr("p_partkey AS scan_id", "p_size AS position", "CASE WHEN p_partkey % 5 = 1 THEN ' ' ELSE 'https://e' END AS source_url", "CASE WHEN p_partkey % 5 = 1 THEN '' ELSE 'x' END AS evidence_snippet", f"CASE p_partkey % 5 WHEN 2 THEN '/programme_catalog/' || p_size || '0/name' WHEN 4 THEN NULL ELSE {own} END AS evidence_path")
    evidence = p.selectExpr("CASE WHEN p_partkey % 5 = 3 THEN -p_partkey ELSE p_partkey END AS scan_id", f"{own} AS claim_path")
    return E.row_provenance(rows, evidence).selectExpr("scan_id AS p_partkey", "message", "field")


# Capture order and diagnostics ----------------------------------------------------------------------------------------

_EV = "(SELECT user_id AS scan_id, event_type AS field, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_order, event_id, event_id % 4 = 0 AS route, CASE event_id % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'no_match' ELSE 'skipped' END AS status, CASE event_id % 6 WHEN 2 THEN 'context_gate_failed' WHEN 3 THEN 'raw_needs_manual_review' WHEN 4 THEN 'undergraduate_context_gate_failed' ELSE 'none' END AS reason, event_id % 5 = 0 AS blocked, event_id % 7 = 0 AS portal FROM events)"


def _attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("page_order", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.selectExpr("user_id AS scan_id", "event_type AS field", "page_order", "event_id", "event_id % 4 = 0 AS route", "CASE event_id % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'no_match' ELSE 'skipped' END AS status", "CASE event_id % 6 WHEN 2 THEN 'context_gate_failed' WHEN 3 THEN 'raw_needs_manual_review' WHEN 4 THEN 'undergraduate_context_gate_failed' ELSE 'none' END AS reason", "event_id % 5 = 0 AS blocked", "event_id % 7 = 0 AS portal")


@query(f"SELECT scan_id, field, page_order, CAST(row_number() OVER (PARTITION BY scan_id, field ORDER BY page_order) - 1 AS INT) AS index FROM {_EV}")
def claim_index(spark, sf_dir):
    return D.claim_index(_attempts(spark, sf_dir).select("scan_id", "field", "page_order"), ["scan_id", "field"], ["page_order"])


@query(f"WITH e AS {_EV}, m AS (SELECT scan_id, field, min(page_order) FILTER (route) AS r, min(page_order) FILTER (NOT route) AS s FROM e GROUP BY 1, 2) SELECT scan_id, field, page_order, route FROM e JOIN m USING (scan_id, field) WHERE route OR (page_order = s AND s < coalesce(r, 999999999))")
def supplement_first_wins(spark, sf_dir):
    return D.kept_supplements(_attempts(spark, sf_dir).select("scan_id", "field", "page_order", "route"))


@query(f"SELECT field, status, count(*) AS n FROM {_EV} GROUP BY GROUPING SETS ((field, status), (field), (status))")
def attempt_counts(spark, sf_dir):
    return D.attempt_counts(_attempts(spark, sf_dir))


_NINE = case("event_id", *map(text, ("undergraduate_application_entry", "application_periods", "english_requirements", "accepted_qualifications", "required_documents", "programmes", "fees", "scholarships", "contacts")))
_NAMES = ("undergraduate_application_entry", "application_periods", "english_requirements", "accepted_qualifications", "required_documents", "programmes", "fees", "scholarships", "contacts")
_FOUND = ", ".join(f"coalesce(bool_or(known) FILTER (field = '{n}'), false) AS {n}" for n in _NAMES)


@query(f"SELECT scan_id, CAST({' + '.join(f'CAST({n} AS INT)' for n in _NAMES)} AS BIGINT) AS found, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT {n} THEN {text(n)} END' for n in _NAMES)}], lambda x: x IS NOT NULL), ',') AS missing, round(({' + '.join(f'CAST({n} AS INT)' for n in _NAMES)}) / 9.0, 3) AS ratio FROM (SELECT scan_id, {_FOUND} FROM (SELECT user_id AS scan_id, {_NINE} AS field, value > 60 AS known FROM events) GROUP BY scan_id)")
def coverage(spark, sf_dir):
    return D.coverage(table(spark, sf_dir, "events").selectExpr("user_id AS scan_id", f"{_NINE} AS field", "value > 60 AS known"))


@query(f"SELECT scan_id, field, CASE WHEN all_blocked THEN 'blocked_or_challenge' WHEN raw THEN 'raw_needs_manual_review' WHEN nm THEN 'attempted_no_match' WHEN gate THEN 'context_gate_failed' WHEN portal THEN 'portal_or_login_required' ELSE 'manual_check_required' END AS canonical_reason FROM (SELECT scan_id, field, bool_or(status = 'extracted') AS ex, bool_and(blocked) AS all_blocked, bool_or(NOT blocked AND reason = 'raw_needs_manual_review') AS raw, bool_or(NOT blocked AND status = 'no_match') AS nm, bool_or(NOT blocked AND contains(reason, 'gate_failed')) AS gate, bool_or(portal) AS portal FROM (SELECT scan_id * 1000 + page_order // 4 AS scan_id, field, status, reason, blocked, portal FROM {_EV}) GROUP BY 1, 2) WHERE NOT ex")
def missing_reasons(spark, sf_dir):
    a = _attempts(spark, sf_dir).withColumn("scan_id", F.col("scan_id") * 1000 + F.floor(F.col("page_order") / 4))
    return D.missing_reasons(a)


@query("SELECT scan_id, page_order, kind, CASE WHEN kind = 'programme' THEN 'programme' WHEN coalesce(max(CASE WHEN kind = 'programme' THEN 1 END) OVER (PARTITION BY scan_id ORDER BY page_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN '/programmes/0/prerequisites' ELSE '/admissions/accepted_qualifications' END AS target FROM (SELECT user_id AS scan_id, event_id AS page_order, CASE WHEN event_id % 50 = 7 THEN 'programme' ELSE 'prerequisite' END AS kind FROM events)")
def prereq_rehome(spark, sf_dir):
    return D.rehomed_prerequisites(table(spark, sf_dir, "events").selectExpr("user_id AS scan_id", "event_id AS page_order", "CASE WHEN event_id % 50 = 7 THEN 'programme' ELSE 'prerequisite' END AS kind"))


@query("WITH f AS (SELECT c_nationkey AS scan_id, CASE WHEN c_custkey % 4 = 1 THEN 'AUTOMOBILE' ELSE c_mktsegment END AS family, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT scan_id, arg_max(family, (n, family)) AS family, max(n) AS top, CAST(sum(n) AS BIGINT) AS total, count(*) AS families FROM f GROUP BY 1) SELECT scan_id, family, families, round(top / total, 3) AS family_url_share, total >= 5 AND families >= 2 AND top / total >= 0.3 AS biased FROM t")
def family_bias_topk(spark, sf_dir):
    return D.family_bias(table(spark, sf_dir, "customer").selectExpr("c_nationkey AS scan_id", "CASE WHEN c_custkey % 4 = 1 THEN 'AUTOMOBILE' ELSE c_mktsegment END AS family"), share=0.3)


@query("SELECT label, count(*) AS urls FROM (SELECT DISTINCT l_partkey, l_returnflag || l_linestatus AS label FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, 'candidate_source' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT -p_partkey - 1, 'candidate_source' FROM part) GROUP BY label")
def source_status_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS url", "l_returnflag || l_linestatus AS label")
    candidates = table(spark, sf_dir, "part").selectExpr("explode(array(p_partkey, -p_partkey - 1)) AS url")
    return D.status_labels(candidates, labels)


# Catalogues, paging, traversal ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_partkey) AS INT) AS duplicate_index FROM part")
def catalog_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "upper(p_name) || ' ' AS name", "p_brand AS award", "cast(null as string) AS faculty", "cast(null as string) AS source_url")
    return K.duplicate_rank(d, [], ["p_partkey"], award="award", faculty="faculty").select("p_partkey", "duplicate_index")


#: Links from each customer to its orders, from each order to another customer.
_EDGE = "(SELECT o_custkey AS a, -o_orderkey AS b FROM orders UNION SELECT -o_orderkey, (o_custkey * 7 + o_orderkey) % (SELECT max(c_custkey) FROM customer) + 1 FROM orders)"


@query(f"WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(e.b AS BIGINT), depth + 1 FROM r JOIN {_EDGE} AS e ON r.node = e.a WHERE depth < 6) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reach_recursive(spark, sf_dir):
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("n"))))
    edges = o.selectExpr("o_custkey AS a", "-o_orderkey AS b").union(o.selectExpr("-o_orderkey", "(o_custkey * 7 + o_orderkey) % n + 1"))
    return C.reach(edges, spark.range(1, 2).selectExpr("id AS node"), 6)


@query()
def crawl_best_first(spark, sf_dir):
    """A site for each customer, with a page for each of its orders and links to neighbours."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS scan_id", "o_orderkey AS n", "CAST(o_orderkey % 13 AS INT) AS score")
    around = Window.partitionBy("scan_id").orderBy("n")
    links = F.array_compact(F.array(F.lead("n", 1).over(around), F.lead("n", 3).over(around), F.lag("n", 2).over(around)))
    captured = o.select("scan_id", F.concat(F.lit("u"), "n").alias("url"), "score", F.transform(links, lambda x: F.concat(F.lit("u"), x.cast("string"))).alias("links"))
    return C.best_first(captured, captured.groupBy("scan_id").agg(F.min("url").alias("seed")), 20, 4)


@query("WITH l AS (SELECT l_orderkey AS source, l_linenumber AS position, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE 'text ' || l_partkey END AS line, CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber END AS marker FROM lineitem), f AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY source ORDER BY position), 1) AS page FROM l) SELECT source, page, string_agg(line, ' ' ORDER BY position, line) AS body FROM f WHERE line IS NOT NULL GROUP BY source, page")
def pdf_page_ffill(spark, sf_dir):
    marker = "CASE WHEN l_linenumber % 2 = 0 THEN 'PDF PAGE ' || l_linenumber ELSE '---PAGE ' || l_linenumber || '---' END"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS source", "l_linenumber AS position", f"CASE WHEN l_linenumber % 3 = 2 THEN {marker} ELSE 'text ' || l_partkey END AS line")
    return C.page_text(lines)


# Differences, merges, limits ------------------------------------------------------------------------------------------


@query("SELECT url FROM pages WHERE page_id % 7 = 0 AND page_id % 5 <> 0")
def diff_sources(spark, sf_dir):
    """Several pages may have one address, so a page's key is its number too."""
    p = table(spark, sf_dir, "pages")
    now = p.select("page_id", "url", F.md5("html").alias("content_hash"))
    old = p.where("page_id % 5 <> 0").select("page_id", "url", F.when(F.col("page_id") % 7 == 0, F.lit("old")).otherwise(F.md5("html")).alias("content_hash"))
    return I.changed(now, old, ["page_id", "url"], "content_hash").select("url")


@query("SELECT path FROM (SELECT '/orders/' || o_orderkey || '/value' AS path FROM orders WHERE o_orderkey % 7 = 0) ORDER BY path LIMIT 20")
def diff_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("'/orders/' || o_orderkey || '/value' AS path", "o_orderstatus AS value", "o_orderkey")
    old = o.selectExpr("path", "CASE WHEN o_orderkey % 7 = 0 THEN value || '!' ELSE value END AS value")
    return I.changed(o.select("path", "value"), old, "path", "value").orderBy("path").limit(20)  # the report names the first 20


@query("SELECT university, field, seed_order, index, CAST(row_number() OVER (PARTITION BY university, field ORDER BY seed_order, index) - 1 AS INT) AS new_index, '/' || field || '/' || (row_number() OVER (PARTITION BY university, field ORDER BY seed_order, index) - 1) || '/value' AS claim_path FROM (SELECT s_nationkey AS university, 'fees' AS field, s_suppkey % 3 AS seed_order, s_suppkey AS index FROM supplier)")
def merge_reindex(spark, sf_dir):
    return I.merged_claims(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS university", "'fees' AS field", "s_suppkey % 3 AS seed_order", "s_suppkey AS index"))


@query("SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, least(c_nationkey * 2, 20)) AS INT) AS max_pages FROM customer")
def batch_limits(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    return d.select("c_custkey", I.limit(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")), F.col("c_nationkey") * 2, F.lit(20)).cast("int").alias("max_pages"))
