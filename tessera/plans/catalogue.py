"""Queries over catalogue pages and JSON catalogues. Expected rows are stated by kind of page, from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalogue as K
from tessera.operators import json_bodies as J
from tessera.plans.base import query, table, values

#: Pages by kind: address, title, text.
_PAGES = (
    ("https://www.nus.edu.sg/undergraduate-programmes", "Undergraduate Programmes", "Programme | Degree | Faculty | Mode | Duration\nBusiness | Bachelor of Business Administration | NUS Business School | Full-time | 3-year\nBusiness | Bachelor of Business Administration | NUS Business School | Part-time | 120 units"),
    ("https://ug.hku.hk/programmes", None, "<li>Bachelor of Arts CODE 6054 FACULTY Faculty of Arts STUDY PERIOD 4 years TYPE Degree Programme</li><p>Bachelor of Laws CODE 6406 FACULTY Faculty of Law STUDY PERIOD 5 years TYPE Double Degree</p>"),
    ("https://www.polyu.edu.hk/study/ug/list", "JUPAS degree list", "Accounting (Finance/Taxation) - BBA - Bachelor of Business Administration JS3131 | full time | 4-year\nEngineering Science - BSc - Bachelor of Science 10501"),
    ("https://chs.nus.edu.sg/majors", "Majors", "CHS Primary Major: Chinese Languages and Cultures requires a second major. BBA Major: Finance, full-time; NUS College.\nCourse Code | Course Title | Open To"),
    ("https://x.edu/tuition-fees", "Tuition fees", "Bachelor of Science degree"),
    ("https://x.edu/pg-programmes", "Postgraduate programmes", "Bachelor of Science degree"),
    ("https://x.edu/programmes", "Programmes", "Programme | Degree | Accountancy | Bachelor of Accountancy | Law | LLB (Hons)"),
    ("https://x.edu/programmes/about", "Programmes", "Applicants to the Bachelor of Arts " + "find a curriculum that students and graduates value " * 8),
    ("https://x.edu/programmes/all", None, "Computing | Bachelor of Computing . Course Code | Open To . Arts | Bachelor of Arts"),
    ("https://x.edu/ug/courses", "Degree courses", "Bachelor of Nursing | School of Nursing | part time | 5 years<br/>Read more about us."),
)
#: Rows by kind and place: name, faculty, award, category, mode, duration, choice, specialisations, warnings.
_ROWS = (
    (0, 0, "Business", "NUS Business School", "Bachelor of Business Administration", "degree_programme", "full-time", "3-year", None, "", "category_inferred"),
    (0, 1, "Business", "NUS Business School", "Bachelor of Business Administration", "degree_programme", "part-time", "120 units", None, "", "duplicate_name,category_inferred"),
    (1, 0, "Bachelor of Arts", "Faculty of Arts", "Bachelor of Arts", "degree_programme", None, "4 years", "6054", "", ""),
    (1, 1, "Bachelor of Laws", "Faculty of Law", "Bachelor of Laws", "dual_degree", None, "5 years", "6406", "", ""),
    (2, 0, "Accounting", None, "Bachelor of Business Administration", "degree_programme", "full-time", "4-year", "JS3131", "Finance; Taxation", "missing_faculty"),
    (2, 1, "Bachelor of Science", None, "Bachelor of Science", "degree_programme", None, None, None, "", "missing_faculty,category_inferred"),
    (3, 0, "CHS Primary Major: Chinese Languages and Cultures", "College of Humanities and Sciences", None, "major", None, None, None, "Chinese Languages and Cultures", "ambiguous_degree,category_inferred,raw_needs_manual_review"),
    (3, 1, "BBA Major: Finance", "College of Humanities and Sciences", "Major within Bachelor of Business Administration (Honours)", "major", "full-time", None, None, "Finance", "category_inferred"),
    (3, 2, "NUS College", "College of Humanities and Sciences", None, "special_programme", None, None, "NUS College", "", "ambiguous_degree,category_inferred,raw_needs_manual_review"),
    (6, 0, "Accountancy", None, "Bachelor of Accountancy", "degree_programme", None, None, None, "", "missing_faculty,category_inferred"),
    (6, 1, "Law", None, "LLB (Hons)", "degree_programme", None, None, None, "", "missing_faculty,category_inferred"),
    (8, 0, "Computing", None, "Bachelor of Computing", "degree_programme", None, None, None, "", "missing_faculty,category_inferred"),
    (8, 1, "Arts", None, "Bachelor of Arts", "degree_programme", None, None, None, "", "missing_faculty,category_inferred"),
    (9, 0, "Bachelor of Nursing", "School of Nursing", "Bachelor of Nursing", "degree_programme", "part-time", "5 years", None, "", ""),
)
_NAMES = "kind, pos, name, faculty_or_school, degree_or_award, category, mode, duration_or_units, admissions_choice_name, specialisations_or_majors, warnings"
_KINDS = len(_PAGES)


def pages(spark, sf_dir):
    """A page for each part, ten to a scan."""
    kinds = spark.createDataFrame([(i, *p) for i, p in enumerate(_PAGES)], "kind int, url string, title string, text string")
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page", f"CAST(p_partkey % {_KINDS} AS INT) AS kind", "p_partkey DIV 10 AS scan_id").join(F.broadcast(kinds), "kind")


@query("SELECT p_partkey AS page, p_partkey % 10 NOT IN (4, 5) AS is_source FROM part")
def catalog_gates(spark, sf_dir):
    return pages(spark, sf_dir).select("page", K.is_catalog_source(F.col("url"), F.col("title"), F.col("text")).alias("is_source"))


_LINES = values(((0, 2), (1, 2), (2, 2), (3, 4), (4, 1), (5, 1), (6, 2), (7, 1), (8, 2), (9, 2)), "kind, n")


@query(f"SELECT p_partkey AS page, CAST(n AS INT) AS n FROM part JOIN {_LINES} AS l ON p_partkey % {_KINDS} = kind")
def catalog_lines(spark, sf_dir):
    return pages(spark, sf_dir).select("page", F.size(K.candidate_lines(F.col("text"))).alias("n"))


_EXPECTED = f"(SELECT p_partkey AS page, p_partkey // 10 AS scan_id, r.*, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey, pos) - 1 AS nth FROM part JOIN {values(_ROWS, _NAMES)} AS r ON p_partkey % {_KINDS} = kind)"


@query(
    f"SELECT scan_id, '/programme_catalog/' || nth || '/name' AS claim_path, {_NAMES.replace('kind, pos, ', '')}, CASE WHEN contains(warnings, 'raw') THEN 'raw_needs_manual_review' ELSE 'parsed' END AS parse_status, CASE WHEN contains(warnings, 'raw') THEN 'medium' ELSE 'high' END AS evidence_confidence FROM {_EXPECTED}"
)
def catalog_rows(spark, sf_dir):
    rows = K.catalog_rows(pages(spark, sf_dir), ["scan_id"], ["page"])
    return rows.withColumns({"specialisations_or_majors": F.array_join("specialisations_or_majors", "; "), "warnings": F.array_join("warnings", ",")}).drop("source_url", "evidence_snippet")


EMPTY = "''"
_CSV = "name, faculty_or_school, degree_or_award, category, mode, duration_or_units, admissions_choice_name, specialisations_or_majors"


@query(
    f"SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN '' ELSE 'u' || scan_id END AS university_id, CASE WHEN scan_id % 3 = 0 THEN '' ELSE 'University ' || scan_id END AS university_name, printf('programme-catalog-%03d', nth + 1) AS programme_id, {', '.join(f'coalesce({c}, {EMPTY}) AS {c}' for c in _CSV.split(', '))}, "
    f"p.url AS source_url, CASE WHEN e.kind % 2 = 0 THEN '' ELSE 'Page ' || e.kind END AS source_title, CASE WHEN contains(warnings, 'raw') THEN 'medium' ELSE 'high' END AS evidence_confidence, CASE WHEN contains(warnings, 'raw') THEN 'raw_needs_manual_review' ELSE 'parsed' END AS parse_status, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END AS n_warnings, CASE WHEN e.kind % 2 = 0 THEN '' ELSE '2026-06-01' END AS retrieved_at "
    f"FROM {_EXPECTED} AS e JOIN {values([(i, p[0]) for i, p in enumerate(_PAGES)], 'kind, url')} AS p USING (kind)"
)
def catalog_csv_projection(spark, sf_dir):
    captured = pages(spark, sf_dir)
    rows = K.catalog_rows(captured, ["scan_id"], ["page"]).withColumn("position", F.regexp_extract("claim_path", "([0-9]+)", 1).cast("int"))
    known = captured.where("kind % 2 = 1")
    old = known.selectExpr("scan_id", "url AS source_url", "'old' AS title", "'2025' AS retrieved_at", "0 AS position")
    sources = old.union(known.selectExpr("scan_id", "url", "'Page ' || kind", "'2026-06-01'", "1"))
    institutions = captured.where("scan_id % 3 <> 0").selectExpr("scan_id", "'u' || scan_id AS university_id", "'University ' || scan_id AS university_name").distinct()
    out = K.csv_rows(rows, sources, institutions)
    count = F.when(F.col("warnings") == "", 0).otherwise(F.json_array_length("warnings"))
    return out.withColumn("n_warnings", count).drop("warnings", "evidence_snippet")


# JSON bodies ----------------------------------------------------------------------------------------------------------

_BODIES = (
    '{"total": 3, "items": [{"programmeName": "Bachelor of Arts in History", "faculty": "Arts", "studyMode": "Full-time", "duration": "4 years", "jupasCode": "JS1001", "majors": ["History", "Ma", "Asian Studies requires honours"]}, {"title": "Minor in Music"}, {"name": "All"}, {"name": "Filter facet Bachelor"}]}',
    "not json",
    '{"data": {"filters": {"level": ["Undergraduate"], "faculty": {"a": 1}, "x": [1]}, "count": true}, "school": "x"}',
    '{"rows": [{"name": "Bachelor of Laws", "award": "LLB", "school": "Law"}, {"name": "bachelor of laws", "award": "llb", "school": "Other"}, {"name": {"x": 1}, "title": "BSc"}], "total": 1}',
    "[]",
)
_API_ROWS = (
    (0, 0, "Bachelor of Arts in History", "Arts", "Bachelor of Arts in History", "degree_programme", "full-time", "4 years", "JS1001", "History; Asian Studies", ""),
    (0, 1, "Minor in Music", None, None, "minor", None, None, None, "", "ambiguous_degree,missing_faculty,raw_needs_manual_review"),
    (3, 0, "Bachelor of Laws", "Law", "LLB", "degree_programme", None, None, None, "", ""),
)


def bodies(spark, sf_dir, texts):
    kinds = spark.createDataFrame(list(enumerate(texts)), "kind int, body string")
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page", f"CAST(p_partkey % {len(texts)} AS INT) AS kind", "p_partkey DIV 10 AS scan_id", "'https://e.edu/api/' || p_partkey AS source_url").join(F.broadcast(kinds), "kind")


@query(
    f"SELECT scan_id, '/programme_catalog/' || nth || '/name' AS claim_path, {_NAMES.replace('kind, pos, ', '')}, CASE WHEN contains(warnings, 'raw') THEN 'raw_needs_manual_review' ELSE 'parsed' END AS parse_status, CASE WHEN contains(warnings, 'raw') THEN 'medium' ELSE 'high' END AS evidence_confidence "
    f"FROM (SELECT p_partkey // 10 AS scan_id, r.*, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey, pos) - 1 AS nth FROM part JOIN {values(_API_ROWS, _NAMES)} AS r ON p_partkey % 5 = kind)"
)
def api_row_gates(spark, sf_dir):
    rows = J.catalog_rows(bodies(spark, sf_dir, _BODIES), ["scan_id"], ["page"])
    return rows.withColumns({"specialisations_or_majors": F.array_join("specialisations_or_majors", "; "), "warnings": F.array_join("warnings", ",")}).drop("source_url", "evidence_snippet")


_PROFILES = (
    (0, 4, 2, 3, "", "total,items,programmeName,faculty,studyMode,duration,jupasCode,majors,title,name", True, "programme_like_object_keys,parseable_programme_rows,pagination_total_count,catalog_vocabulary", None, 2, False, True),
    (1, 0, 0, None, "", "", False, "", "invalid_json", 0, False, False),
    (2, 0, 0, 1, "faculty,level", "data,filters,level,faculty,a,x,count,school", True, "pagination_total_count,catalog_filter_metadata,catalog_vocabulary", None, 0, False, True),
    (3, 3, 2, 1, "", "rows,name,award,school,x,title,total", True, "programme_like_object_keys,parseable_programme_rows,pagination_total_count,catalog_vocabulary", None, 2, True, False),
    (4, 0, 0, None, "", "", False, "", "body_not_catalog_like", 0, False, False),
)
_PROFILE_NAMES = "candidate_objects, parseable_rows, total, filter_keys, sample_keys, likely_catalog, signals, rejection_reason, rejected_rows, complete, incomplete"


@query(f"SELECT p_partkey AS page, {_PROFILE_NAMES.replace(' total,', ' CAST(total AS BIGINT) AS total,')} FROM part JOIN {values(_PROFILES, 'kind, ' + _PROFILE_NAMES)} AS r ON p_partkey % 5 = kind")
def api_body_profile(spark, sf_dir):
    accepted = F.when(F.col("kind") == 0, 2).when(F.col("kind") == 3, 1).otherwise(0)
    out = J.profiles(bodies(spark, sf_dir, _BODIES), accepted)
    return out.select("page", *(F.array_join(c, ",").alias(c) if c in ("filter_keys", "sample_keys", "signals") else c for c in _PROFILE_NAMES.split(", ")))


_CLAIM_BODIES = ('{"items": [{"programmeName": "Bachelor of Arts", "tuitionFee": "SGD 100", "applicationDeadline": "1 May 2027"}, {"name": "Office", "fee": 7, "documents": ["Passport", "Photo"]}]}', '{"title": "Major in Music", "documents": {"a": 1}, "closing_date": ""}', "{", '{"x": [{"document": "CV"}]}')
_CLAIMS = ((0, 0, "programmes", "Bachelor of Arts"), (0, 0, "application_periods", "1 May 2027"), (0, 0, "fees", "SGD 100"), (0, 1, "fees", "7"), (0, 1, "required_documents", "Passport, Photo"), (1, 0, "programmes", "Major in Music"), (1, 0, "required_documents", '{"a": 1}'), (3, 0, "required_documents", "CV"))


@query(
    "SELECT scan_id, field, CASE field WHEN 'programmes' THEN '/programmes/' || nth || '/name' WHEN 'fees' THEN '/fees/' || nth || '/value' ELSE '/admissions/' || field || '/' || nth || '/value' END AS claim_path, value "
    f"FROM (SELECT p_partkey // 10 AS scan_id, r.*, row_number() OVER (PARTITION BY p_partkey // 10, field ORDER BY p_partkey, pos) - 1 AS nth FROM part JOIN {values(_CLAIMS, 'kind, pos, field, value')} AS r ON p_partkey % 4 = kind)"
)
def api_claims(spark, sf_dir):
    return J.claims(bodies(spark, sf_dir, _CLAIM_BODIES), ["scan_id"], ["page"]).drop("snippet", "source_url")


_LINK_BODY = '{"b": "/x.html", "a": ["https://o.edu/p", "file.PDF?x=1", "plain", 5, "/x.html"], "c": "../up.json"}'


@query(f"SELECT p_partkey AS page, unnest({['https://h.edu/x.html', 'https://o.edu/p', 'https://h.edu/a/file.PDF?x=1', 'https://h.edu/up.json']}) AS link FROM part WHERE p_partkey % 2 = 0")
def json_links(spark, sf_dir):
    d = bodies(spark, sf_dir, (_LINK_BODY, "[1"))
    return d.select("page", F.explode(J.json_links(F.col("body"), F.lit("https://h.edu/a/b"))).alias("link"))


@query("SELECT p_partkey AS page, CASE p_partkey % 2 WHEN 0 THEN '{' || chr(10) || '  \"a\": [' || chr(10) || '    2' || chr(10) || '  ],' || chr(10) || '  \"b\": \"é\"' || chr(10) || '}' ELSE '{\"b\":' END AS body FROM part")
def json_pretty(spark, sf_dir):
    return bodies(spark, sf_dir, ('{"b":"é","a":[2]}', '{"b":')).select("page", J.pretty(F.col("body")).alias("body"))


_SHELL_TEXTS = (("Programme level\nProgramme type Undergraduate", True), ("Filter all full-time part-time study mode programme", True), ("Programme level Programme type Undergraduate Bachelor of Arts degree", False), ("Programme | Degree Programme level programme type", False), ("", False), ("filter all full-time part-time", False))


@query(f"SELECT p_partkey AS page, shell FROM part JOIN {values([(i, s) for i, (_, s) in enumerate(_SHELL_TEXTS)], 'kind, shell')} AS r ON p_partkey % 6 = kind")
def dynamic_shell(spark, sf_dir):
    return bodies(spark, sf_dir, [t for t, _ in _SHELL_TEXTS]).select("page", J.is_dynamic_shell(F.col("body")).alias("shell"))


@query("SELECT p_partkey AS page, p_partkey % 4 > 1 OR p_partkey % 7 > 1 OR p_partkey % 5 = 0 OR p_partkey % 3 = 2 AS high FROM part")
def high_cardinality(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("page"), J.high_cardinality(k % 4, k % 7, F.when(k % 5 == 0, "page"), F.when(k % 3 > 0, k % 3)).alias("high"))


_NEXT = (
    ("https://e.edu/api?after=a&x=1", '{"d": {"pageInfo": {"hasNextPage": true, "endCursor": "b c"}}}', "https://e.edu/api?after=b+c&x=1", "cursor", False, "next_cursor"),
    ("https://e.edu/api", '{"page": 1, "page_info": {"hasNextPage": false}}', None, "cursor", True, "pagination_complete"),
    ("https://e.edu/api", '[{"pageInfo": {"hasNextPage": true}}]', None, "cursor", False, "cursor_without_end_cursor"),
    ("https://e.edu/api?Offset=20&limit=10", '{"total": 50}', "https://e.edu/api?Offset=30&limit=10", "offset", False, "next_offset"),
    ("https://e.edu/api?skip=40&take=10", '{"total": 50}', None, "offset", True, "pagination_complete"),
    ("https://e.edu/api", '{"offset": 0, "pageSize": 25, "count": 60}', "https://e.edu/api?offset=25", "offset", False, "next_offset"),
    ("https://e.edu/api?page=2", '{"totalPages": 2}', None, "page", True, "pagination_complete"),
    ("https://e.edu/api?pageNumber=1&size=20", '{"total": 41}', "https://e.edu/api?pageNumber=2&size=20", "page", False, "next_page"),
    ("https://e.edu/api?pageNumber=3&size=20", '{"total": 41}', None, "page", True, "pagination_complete"),
    ("https://e.edu/api", '{"currentPage": 1}', "https://e.edu/api?page=2", "page", False, "next_page"),
    ("https://e.edu/api", '{"x": 1, "pageInfo": {}}', None, None, False, "pagination_not_detected"),
    ("https://e.edu/api", "x", None, None, False, "invalid_json"),
    ("https://e.edu/api?offset=x", '{"limit": 5}', None, None, False, "pagination_not_detected"),
)


@query(f"SELECT p_partkey AS page, url, mode, complete, reason FROM part JOIN {values([(i, *r[2:]) for i, r in enumerate(_NEXT)], 'kind, url, mode, complete, reason')} AS r ON p_partkey % 13 = kind")
def pagination_plan(spark, sf_dir):
    kinds = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(_NEXT)], "kind int, address string, body string")
    d = table(spark, sf_dir, "part").selectExpr("p_partkey AS page", "CAST(p_partkey % 13 AS INT) AS kind").join(F.broadcast(kinds), "kind")
    return d.withColumn("f", J.facts(F.col("body"))).withColumn("n", J.next_page(F.col("f"), F.col("address"))).select("page", "n.*")


_WALK = "SELECT p_partkey AS endpoint, p_partkey % 8 + 1 AS t, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 8 >= 2 THEN 2 WHEN p_partkey % 3 = 2 AND p_partkey % 8 >= 1 THEN 1 WHEN p_partkey % 33 = 0 AND p_partkey % 8 >= 1 THEN 1 WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 0 AND p_partkey % 8 >= 1 THEN 1 END AS cut FROM part"


@query(
    "SELECT endpoint, 'page' AS mode, CAST(coalesce(cut, least(t, 5)) AS INT) AS page_count, CASE WHEN cut IS NULL THEN least(t, 5) - 1 ELSE cut - 1 END AS fetched, cut IS NULL AND t < 5 AS completed, cut IS NULL AND t >= 5 AS budget_hit, "
    f"CASE WHEN cut = 2 THEN 'fetch_failed' WHEN cut = 1 AND endpoint % 3 = 2 THEN 'non_json_response' WHEN cut = 1 AND endpoint % 33 = 0 THEN 'duplicate_page_body' WHEN cut = 1 THEN 'rejected_auth_or_token' WHEN t < 5 THEN 'pagination_complete' ELSE 'pagination_budget_hit' END AS stop_reason FROM ({_WALK})"
)
def pagination_walk(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS endpoint", "p_partkey % 8 + 1 AS t", "'https://e.edu/api/' || p_partkey || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 0 AND p_partkey % 33 <> 0 THEN '?token=1&page=' ELSE '?page=' END AS base")
    pages = p.selectExpr("endpoint", "t", "base", "explode(sequence(1, CAST(t AS INT))) AS k").where("NOT (endpoint % 3 = 1 AND k = 3)")
    captured = pages.selectExpr("base || k AS url", "true AS ok", "NOT (endpoint % 3 = 2 AND k = 2) AS is_json", "'{\"totalPages\": ' || t || '}' AS body", "CASE WHEN endpoint % 33 = 0 THEN 'same' ELSE base || k END AS content_hash")
    out = J.pages_followed(p.selectExpr("endpoint", "base || '1' AS url"), captured)
    return out.select("endpoint", "mode", "page_count", F.size("fetched").alias("fetched"), "completed", "budget_hit", "stop_reason")


_CORE = "level=x&mode=Full+Time&q=1&studyLevel=ug"


@query(
    f"SELECT p_partkey AS endpoint, array_to_string((['https://e.edu/api?{_CORE}'] || list_transform(range(1, p_partkey % 7 + 1), lambda i: 'https://e.edu/api?faculty=F' || i || '&{_CORE}'))[1:5], ' ') AS urls, p_partkey % 7 > 4 AS budget_hit FROM part"
)
def filter_plan(spark, sf_dir):
    body = '\'{"facets": [{"field": "studyLevel", "options": [{"label": "Undergraduate", "value": "ug"}, {"value": "pg"}]}], "filters": {"faculty": [\' || array_join(transform(filter(sequence(0, 6), i -> i > 0 AND i <= p_partkey % 7), i -> \'"F\' || i || \'"\'), \',\') || \'], "mode": ["Full Time"]}}\''
    d = table(spark, sf_dir, "part").selectExpr("p_partkey AS endpoint", f"{body} AS body").withColumn("options", J.filter_options(F.col("body")))
    return d.select("endpoint", J.filter_plan(F.col("options"), F.lit("https://e.edu/api?level=x&q=1")).alias("p")).select("endpoint", F.array_join("p.urls", " ").alias("urls"), "p.budget_hit")
