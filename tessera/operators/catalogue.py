"""Programme rows from the text of catalogue pages, with quality warnings, and the CSV projection.

Pages are cut into candidate lines; every line is parsed by the first form that fits: a labelled card, an award listing,
a table row with an award cell, any table row, or an award's name in free text. Lines of course tables and long prose are
refused. Rows are never dropped as duplicates: the second row of a normalised key and later ones carry a warning.

Defined cases: null texts and titles are empty; a page that is no catalogue source gives no rows; other columns of pages
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules as R
from tessera.functions.columns import bound, contains_any, nullif_empty

REVIEW = "raw_needs_manual_review"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def clean(text: Column) -> Column:
    """Single blanks; blanks, dashes and bars at the ends go."""
    return F.regexp_replace(_spaces(text), r"^[ \-|]+|[ \-|]+$", "")


def clean_name(name: Column) -> Column:
    """A name without what follows it in a sentence or card."""
    for pattern in R.NAME_TAIL_PATTERNS:
        name = F.regexp_replace(name, pattern, "")
    return F.regexp_replace(clean(name), r"[.;:,]+$", "")


def is_catalog_source(url: Column, title: Column, text: Column) -> Column:
    """Whether a page may list programmes: about undergraduate degrees, and no long admissions page."""

    def judged(p: Column) -> Column:
        named, hay = p["named"], p["hay"]
        longform = ~contains_any(named, R.CATALOG_URL_TERMS) & contains_any(named, R.ADMISSIONS_LONGFORM_TERMS)
        topic = F.when(contains_any(hay, R.CATALOG_GRADUATE_TERMS), hay.contains("undergraduate")).otherwise(contains_any(hay, R.CATALOG_TOPIC_TERMS))
        return ~longform & contains_any(hay, R.CATALOG_LEVEL_TERMS) & topic

    empty = lambda c: F.coalesce(c, F.lit(""))
    named = F.lower(F.concat_ws(" ", empty(url), empty(title)))
    return bound(F.struct(named.alias("named"), F.lower(F.concat_ws(" ", empty(url), empty(title), empty(text))).alias("hay")), judged)


def faculty_hint(url: Column, title: Column, text: Column) -> Column:
    """The first known faculty that the title, the address or the head of the text names."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), url, F.substring(F.coalesce(text, F.lit("")), 1, 500)))
    return bound(hay, lambda h: F.coalesce(*(F.when(contains_any(h, needles), F.lit(label)) for label, needles in R.FACULTY_HINTS)))


def category_of(name: Column, context: Column) -> Column:
    """major, minor, special_programme or degree_programme, else null."""

    def of(lower: Column) -> Column:
        return (
            F.when(lower.contains("major:") | lower.contains("primary major"), "major")
            .when(lower.contains("minor:"), "minor")
            .when(contains_any(lower, ("special programme", "nus college", "e-scholars")), "special_programme")
            .when(lower.contains("bachelor") | lower.rlike(R.DEGREE_WORDS_PATTERN), "degree_programme")
        )

    return bound(F.lower(F.concat_ws(" ", name, context)), of)


def category_of_type(kind: Column) -> Column:
    lower = F.lower(kind)
    return F.when(lower.contains("double degree") | lower.contains("dual degree"), "dual_degree").when(lower.contains("degree") | lower.contains("program"), "degree_programme").otherwise("unknown")


def is_course_table(line: Column) -> Column:
    """Whether a line is of a table of courses, which isn't one of programmes."""

    def of(p: Column) -> Column:
        line, lower = p["line"], p["lower"]
        units = F.concat(F.lit(" "), lower, F.lit(" ")).contains(" au ")
        opens, prior, titles = lower.contains("open to"), lower.contains("pre-req"), lower.contains("course title")
        headers = F.size(F.filter(F.array(*map(F.lit, R.COURSE_TABLE_HEADERS)), lambda t: lower.contains(t)))
        return ~(lower.contains("programme | degree") | lower.contains("program | degree")) & (
            lower.contains("major pe courses")
            | (lower.contains("course code") & (titles | opens))
            | (opens & (lower.contains("course") | units | prior))
            | (headers >= 3)
            | (line.rlike(R.COURSE_CODE_PATTERN) & (opens | units | prior | titles))
        )

    return bound(F.struct(line.alias("line"), F.lower(line).alias("lower")), of)


def is_prose(line: Column) -> Column:
    return ~line.contains("|") & ((F.length(line) > 700) | ((F.length(line) > 320) & (F.regexp_count(F.lower(line), F.lit(R.PROSE_PATTERN)) >= 3)))


def is_award(value: Column) -> Column:
    return value.rlike(R.AWARD_PATTERN)


def is_name_cell(cell: Column) -> Column:
    """Whether a cell can be a programme's name."""

    def of(c: Column) -> Column:
        lower = F.lower(c)
        fits = F.length(c).between(3, 160) & ~lower.isin(*R.NAME_CELL_NOT) & ~contains_any(lower, R.NAME_CELL_NOT_TERMS) & ~is_prose(c)
        return fits & (category_of(c, c).isNotNull() | lower.rlike(R.SUBJECT_PATTERN) | c.rlike(r"^[A-Z][A-Za-z&/(),'+\- ]+$"))

    return bound(clean(cell), of)


def _joined(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def is_header(cells: Column) -> Column:
    text = F.lower(F.array_join(cells, " "))
    return text.contains("programme") & text.contains("degree") & ~F.exists(cells, lambda c: category_of(c, c).isNotNull())


def _row_cells(cells: Column) -> Column:
    """Whether cells look like a row of a catalogue's table."""
    named = is_name_cell(F.get(cells, 0)) & is_award(F.get(cells, 1))
    return (F.size(cells) >= 2) & ~is_course_table(_joined(cells)) & ~is_header(cells) & (named | F.exists(cells, lambda c: category_of(c, _joined(cells)).isNotNull()))


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), clean), lambda c: c != "")


def _flattened(line: Column) -> Column:
    """Rows of a table that was flattened into one line: by full stops between rows, else two cells a row after a header
    of two."""
    parts = F.filter(F.transform(F.split(line, r"\s+[.;]\s+"), clean), lambda p: p != "")
    explicit = F.when(F.size(parts) > 1, F.transform(F.filter(F.transform(parts, _cells), _row_cells), _joined)).otherwise(_no_texts())

    def paired(cells: Column) -> Column:
        head = F.lower(F.array_join(F.slice(cells, 1, 3), " "))
        asked = (F.size(cells) >= 4) & head.contains("programme") & (head.contains("degree") | head.contains("award"))
        starts = F.sequence(F.lit(3), F.size(cells) - 1, F.lit(2))
        return F.when(asked, F.transform(F.filter(F.transform(starts, lambda i: F.slice(cells, i, 2)), _row_cells), _joined)).otherwise(_no_texts())

    return bound(explicit, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(bound(_cells(line), paired)))


def candidate_lines(text: Column) -> Column:
    """Lines of a page that may hold a programme: table rows with bars between cells, or sentences."""
    broken = F.regexp_replace(F.regexp_replace(text, r"(?i)<\s*br\s*/?\s*>", "\n"), r"(?i)</(?:li|tr|p|h[1-6]|div|section)>", "\n")
    lines = F.filter(F.transform(F.split(F.regexp_replace(broken, r"<[^>]+>", " "), r"[\n\r]+"), clean), lambda x: x != "")

    def of(line: Column) -> Column:
        sentences = F.filter(F.transform(F.split(line, r"(?<=[.;])\s+"), clean), lambda s: s != "")
        row = bound(_cells(line), lambda cells: F.when((F.size(cells) >= 2) & is_header(cells), _no_texts()).otherwise(F.array(_joined(cells))))
        return F.when(~line.contains("|"), sentences).otherwise(bound(_flattened(line), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(row)))

    return F.flatten(F.transform(lines, of))


def mode_of(value: Column) -> Column:
    lower = F.lower(value)
    return F.when(lower.contains("full-time") | lower.contains("full time"), "full-time").when(lower.contains("part-time") | lower.contains("part time"), "part-time")


def duration_of(value: Column) -> Column:
    return nullif_empty(clean(F.regexp_replace(F.regexp_extract(value, R.DURATION_PATTERN, 1), R.DURATION_CUT_PATTERN, "")))


def _first(values: Column, f) -> Column:
    """The first value that ``f`` makes of one, null where it makes none."""
    return F.get(F.filter(F.transform(values, f), lambda v: v.isNotNull()), 0)


def _pick(values: Column, test) -> Column:
    return F.get(F.filter(values, test), 0)


def _names(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(clean_name(p), r"(?i)^\s*and\s+", "")), lambda v: F.length(v) > 2)


def in_parentheses(text: Column) -> Column:
    """Names between slashes in the first parenthesis that has any."""
    found = F.regexp_extract(text, r"\(([^)]*/[^)]*)\)", 1)
    return F.filter(F.transform(F.split(found, "/"), clean_name), lambda v: F.length(v) > 2)


def specialisations(line: Column) -> Column:
    listed = F.regexp_extract(line, R.SPECIALISATION_PATTERN, 1)
    return F.when(listed != "", _names(F.split(listed, "[,;]"))).otherwise(in_parentheses(line))


def admissions_choice(line: Column, name: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(line.rlike(R.CHOICE_PATTERN), clean_name(F.regexp_extract(line, R.CHOICE_PATTERN, 1)))
        .when(lower.contains("business administration"), "Business Administration")
        .when(lower.contains("computing in computer science"), "Common Computer Science Programmes")
        .when(lower.contains("engineering"), "Engineering")
        .when(lower.contains("nus college"), "NUS College")
    )


def _degree(name: Column, context: Column, category: Column) -> Column:
    award = F.regexp_extract(context, R.CONTEXT_AWARD_PATTERN, 1)
    major = F.when(award != "", clean_name(award)).when(F.lower(name).contains("bba"), "Major within Bachelor of Business Administration (Honours)").when(F.lower(name).contains("bsc"), "Bachelor of Science (Honours)")
    return F.when(category == "degree_programme", name).when(category == "major", major)


def _row(name, faculty, award, category, mode, duration, choice, special, inferred) -> Column:
    return F.struct(name.alias("name"), faculty.alias("faculty"), award.alias("award"), category.alias("category"), mode.alias("mode"), duration.alias("duration"), choice.alias("choice"), special.alias("specialisations"), inferred.alias("inferred"))


def _labelled(line: Column) -> Column:
    group = lambda n: F.regexp_extract(line, R.LABELLED_ROW_PATTERN, n)
    row = bound(clean_name(group(1)), lambda name: _row(name, clean(group(3)), name, category_of_type(group(5)), mode_of(line), clean(group(4)), clean(group(2)), _no_texts(), F.lit(False)))
    return F.when(line.rlike(R.LABELLED_ROW_PATTERN), row)


def _listing(cells: Column) -> Column:
    first, rest = F.get(cells, 0), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    group = lambda n: F.regexp_extract(first, R.AWARD_LISTING_PATTERN, n)
    name = clean(F.regexp_replace(clean(group(1)), r"\s*\([^)]*/[^)]*\)", ""))
    row = _row(name, _none(), clean(group(3)), F.lit("degree_programme"), F.coalesce(mode_of(first), _first(rest, mode_of)), F.coalesce(duration_of(first), _first(rest, duration_of)), nullif_empty(clean(group(4))), in_parentheses(clean(group(1))), F.lit(False))
    return F.when(first.rlike(R.AWARD_LISTING_PATTERN), row)


def _others(cells: Column, faculty: Column) -> Column:
    return F.filter(cells, lambda c: faculty.isNull() | (c != faculty))


def _choice_cell(cells: Column) -> Column:
    return _pick(cells, lambda c: contains_any(F.lower(c), R.CHOICE_TERMS))


def _faculty_cell(cells: Column) -> Column:
    return _pick(cells, lambda c: c.rlike(R.FACULTY_PATTERN))


def _with_award(cells: Column) -> Column:
    name, award, context = clean_name(F.get(cells, 0)), clean(F.get(cells, 1)), _joined(cells)
    rest = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
    category = F.coalesce(category_of(name, context), category_of(award, context))
    row = bound(_faculty_cell(rest), lambda faculty: _row(name, faculty, award, category, _first(rest, mode_of), _first(rest, duration_of), _choice_cell(_others(rest, faculty)), _no_texts(), category_of(name, name).isNull()))
    return F.when(is_name_cell(name) & is_award(award) & category.isNotNull(), row)


def _any_row(cells: Column) -> Column:
    context = _joined(cells)

    def of(name: Column) -> Column:
        rest, category = F.filter(cells, lambda c: c != name), category_of(name, context)
        row = bound(
            _faculty_cell(rest),
            lambda faculty: _row(name, faculty, F.coalesce(_pick(_others(rest, faculty), is_award), _degree(name, context, category)), category, _first(rest, mode_of), _first(rest, duration_of), _choice_cell(_others(rest, faculty)), _no_texts(), F.lit(False)),
        )
        return F.when(name.isNotNull() & category.isNotNull(), row)

    return bound(_pick(cells, lambda c: category_of(c, c).isNotNull()), of)


def _free(line: Column, unknown: bool) -> Column:
    names = F.coalesce(*(F.when(line.rlike(p), clean_name(F.regexp_extract(line, p, 1))) for p in R.FREE_NAME_PATTERNS))

    def of(name: Column) -> Column:
        category = category_of(name, line)
        if unknown:
            category = F.coalesce(category, F.lit("unknown"))
        row = _row(name, _none(), _degree(name, line, category), category, mode_of(line), duration_of(line), admissions_choice(line, name), _no_texts(), F.lit(True))
        return F.when((name != "") & ~is_prose(line) & category.isNotNull(), row)

    return bound(names, of)


def parsed_row(line: Column, unknown: bool = False) -> Column:
    """struct<name, faculty, award, category, mode, duration, choice, specialisations, inferred> of a candidate line, or
    null. ``unknown``: keep free-text rows without a category, for a hint."""
    cells = F.when(line.contains("|"), F.transform(F.split(line, r"\|"), clean)).otherwise(_no_texts())
    table = bound(cells, lambda c: F.when(F.size(c) >= 2, F.coalesce(_listing(c), _with_award(c), _any_row(c))))
    return F.when(~is_course_table(line), F.coalesce(_labelled(line), table, _free(line, unknown)))


def catalog_rows(pages: DataFrame, key: list[str], order: list[str], start: int = 0) -> DataFrame:
    """Programme rows of pages (url, title, text), numbered by ``order`` within ``key``: key, claim_path, the columns of
    the catalogue, parse_status, evidence_snippet, evidence_confidence and the labels of quality warnings."""
    url, title, text = F.col("url"), F.col("title"), F.col("text")
    lines = pages.where(is_catalog_source(url, title, text)).select(*key, *order, "url", "title", faculty_hint(url, title, text).alias("_hint"), F.posexplode(candidate_lines(text)).alias("_pos", "_line"))
    rows = lines.withColumn("_row", parsed_row(F.col("_line"))).where("_row is not null")
    special = F.when(F.size("_row.specialisations") > 0, F.col("_row.specialisations")).otherwise(specialisations(F.col("_line")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order, "_pos")) - 1 + start
    rows = rows.select(
        *key,
        *order,
        "_pos",
        nth.alias("_nth"),
        F.col("_row.name").alias("name"),
        nullif_empty(F.coalesce(nullif_empty(F.col("_row.faculty")), F.col("_hint"))).alias("faculty_or_school"),
        nullif_empty(F.trim("_row.award")).alias("degree_or_award"),
        F.col("_row.category").alias("category"),
        F.col("_row.mode").alias("mode"),
        F.col("_row.duration").alias("duration_or_units"),
        F.col("_row.choice").alias("admissions_choice_name"),
        special.alias("specialisations_or_majors"),
        F.col("url").alias("source_url"),
        F.substring(clean(F.col("_line")), 1, 700).alias("evidence_snippet"),
        F.col("_row.inferred").alias("_inferred"),
    )
    return with_row_quality(rows, [*key, *order], ["_pos"]).drop("_pos", "_nth", "_inferred", *(o for o in order if o not in key))


def duplicate_rank(rows: DataFrame, key: list[str], order: list[str], name: str = "name", award: str = "degree_or_award", faculty: str = "faculty_or_school") -> DataFrame:
    """``duplicate_index``: 1 for the first row of a normalised (name, award, faculty, source), 2 for the next."""
    norm = lambda c: F.lower(F.trim(_spaces(F.coalesce(F.col(c), F.lit("")))))
    parts = [norm(name), norm(award), norm(faculty), norm("source_url")]
    return rows.withColumn("duplicate_index", F.row_number().over(Window.partitionBy(*key, *parts).orderBy(*order)))


def with_row_quality(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds claim_path, parse_status, evidence_confidence and the labels of row warnings in their order."""
    parsed = (F.col("name") != "") & (F.col("category") != "unknown") & F.col("degree_or_award").isNotNull()
    labels = {"duplicate_name": F.col("duplicate_index") > 1, "ambiguous_degree": F.col("degree_or_award").isNull(), "missing_faculty": F.col("faculty_or_school").isNull(), "category_inferred": F.col("_inferred"), REVIEW: ~parsed}
    warnings = F.filter(F.array(*(F.when(test, F.lit(label)) for label, test in labels.items())), lambda w: w.isNotNull())
    out = duplicate_rank(rows, key, order)
    return out.withColumns(
        {
            "claim_path": F.concat(F.lit("/programme_catalog/"), F.col("_nth").cast("string"), F.lit("/name")),
            "parse_status": F.when(parsed, "parsed").otherwise(REVIEW),
            "evidence_confidence": F.when(parsed, "high").otherwise("medium"),
            "warnings": warnings,
        }
    ).drop("duplicate_index")


def row_warnings(labels: Column, claim_path: Column, source_url: Column, messages: dict[str, str] = R.ROW_WARNINGS) -> Column:
    """The warnings of a row as array<struct<code, message, field, source_urls>>."""
    said = F.create_map(*(F.lit(x) for pair in messages.items() for x in pair))
    return F.transform(labels, lambda w: F.struct(F.lit("needs_manual_check").alias("code"), F.concat(w, F.lit(": "), said[w]).alias("message"), claim_path.alias("field"), F.array(source_url).alias("source_urls")))


def csv_rows(rows: DataFrame, sources: DataFrame, institutions: DataFrame) -> DataFrame:
    """The catalogue's CSV lines: 18 columns of text in a fixed order, ids by ``position`` within a scan, titles and times
    from the last source of an address, one institution (scan_id, university_id, university_name) a scan."""
    last = sources.groupBy("scan_id", "source_url").agg(F.max_by(F.struct("title", "retrieved_at"), "position").alias("_source"))
    nth = F.row_number().over(Window.partitionBy("scan_id").orderBy("position"))
    joined = rows.withColumn("programme_id", F.format_string("programme-catalog-%03d", nth)).join(last, ["scan_id", "source_url"], "left").join(institutions, "scan_id", "left")
    listed = row_warnings(F.col("warnings"), F.col("claim_path"), F.col("source_url"))
    given = {
        "specialisations_or_majors": F.array_join("specialisations_or_majors", "; "),
        "source_title": F.col("_source.title"),
        "retrieved_at": F.col("_source.retrieved_at"),
        "warnings": F.when(F.size("warnings") > 0, F.to_json(listed)),
    }
    return joined.select("scan_id", *(F.coalesce(given.get(c, F.col(c)), F.lit("")).alias(c) for c in R.CATALOG_CSV_FIELDS))
