"""Registration of queries with their SQL, and the derived inputs that both state with the same expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(key: str, *values: str) -> str:
    """CASE over key modulo the number of values; valid in both engines."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A table of literals; valid in both engines."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else text(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names}))"


#: Admissions-like pages by order key: path, title and sentence templates of co-prime cycle lengths, so that they mix.
_PATHS = ("/admissions/undergraduate", "/fees", "/news/2026/story", "/programmes/list", "/visa", "/undergraduate-education/majors", "/study/ug/requirements", "/research/labs", "/contact-us/form", "/scholarships/financial-aid", "/postgraduate/tuition", "/apply/deadlines.pdf")
_TITLES = ("Undergraduate Admissions", "Tuition Fees", "Campus News", "Degree Programmes", "Student Pass and Visa", "International Requirements", "Contact the Admissions Office")
_SENTENCES = ("Undergraduate applicants apply by the deadline of 15 January 2027.", "Tuition fees for international students are SGD 32000 per year.", "Alumni giving and staff news from the press blog.", "Bachelor of Engineering requires Mathematics.", "English language requirements: IELTS overall 6.5.", "Scholarship and financial aid enquiries.", "Please log in to the portal.", "Verify you are human to continue.", "A-level and IB diploma are accepted qualifications for freshmen.", "Housing and accommodation near campus.", "Contact the admissions office by email.")
PAGE_URL = "'https://www.example.edu.sg' || " + case("o_orderkey", *map(text, _PATHS))
PAGE_TITLE = case("o_orderkey", *map(text, _TITLES))
PAGE_TEXT = case("o_orderkey", *map(text, _SENTENCES)) + " || ' ' || " + case("(o_orderkey + 5)", *map(text, _SENTENCES))
PAGE_TYPE = case("o_orderkey", "'html'", "'html'", "'pdf'", "'html'", "'json'")
PAGES_SQL = f"(SELECT o_orderkey AS page_id, {PAGE_URL} AS url, {PAGE_TITLE} AS title, {PAGE_TEXT} AS body, {PAGE_TYPE} AS kind FROM orders)"


def derived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"{PAGE_URL} AS url", f"{PAGE_TITLE} AS title", f"{PAGE_TEXT} AS body", f"{PAGE_TYPE} AS kind")


# The same predicates as SQL text for DuckDB.
def sql_any(value: str, terms) -> str:
    return "(" + " OR ".join(f"contains({value}, {text(t)})" for t in terms) + ")"


def sql_count(value: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({value}, {text(t)}) AS INT)" for t in terms) + ")"


def sql_listed(value: str, terms, prefix: str = "") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({value}, {text(t)}) THEN {text(prefix + t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"


_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def sql_part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{_RFC}', {n})"


def sql_path(url: str) -> str:
    return f"regexp_replace({sql_part(url, 3)}, ';[^/]*$', '')"


def sql_host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({sql_part(url, 2)})), '^.*@', ''), '^([^:]*):(?:80|443)$', '\1')"
