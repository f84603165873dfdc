"""Field extractors and value parsers: text in, typed columns out; null where nothing is proven."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.columns import contains_any, nullif_empty
from tessera.functions.english import cleaned
from tessera.functions.rules import DATE_PATTERN, FEE_PATTERN, MONEY_PATTERN, PROGRAMME_PATTERN
from tessera.functions.text import collapsed, sentence_with

_TO = r"\s*(?:-|to|until|through|–)\s*"


def _cut(text: Column, pattern: str, n: int) -> Column:
    return nullif_empty(F.regexp_extract(text, pattern, n))


def deadline(text: Column) -> Column:
    """struct<value, open_date, deadline, snippet> of the first period, opening or deadline phrase, in that order."""
    period = rf"(?i)((?:application period|application window)[:\s|]+({DATE_PATTERN}){_TO}({DATE_PATTERN}))"
    opening = rf"(?i)((?:apply from|applications? open)[:\s]+({DATE_PATTERN}){_TO}({DATE_PATTERN}))"
    single = rf"(?i)((?:apply by|deadline|closing date(?:\s+on)?|application deadline)[:\s]+({DATE_PATTERN}))"
    ranged = F.coalesce(*(F.when(text.rlike(p), F.struct(collapsed(F.regexp_extract(text, p, 2)).alias("a"), collapsed(F.regexp_extract(text, p, 3)).alias("b"), collapsed(F.regexp_extract(text, p, 1)).alias("s"))) for p in (period, opening)))
    one = F.when(text.rlike(single), F.struct(F.lit(None).cast("string").alias("a"), collapsed(F.regexp_extract(text, single, 2)).alias("b"), collapsed(F.regexp_extract(text, single, 1)).alias("s")))
    found = F.coalesce(ranged, one)
    value = F.when(found["a"].isNotNull(), F.concat(found["a"], F.lit(" to "), found["b"])).otherwise(found["b"])
    return F.when(found.isNotNull(), F.struct(value.alias("value"), found["a"].alias("open_date"), found["b"].alias("deadline"), found["s"].alias("snippet")))


def application_dates(text: Column) -> Column:
    """struct<open_date, deadline, round, applicant_group, intake>."""
    clean = F.regexp_replace(collapsed(text), r"^[ ;,.]+|[ ;,.]+$", "")
    ranged, single = rf"(?i)({DATE_PATTERN}){_TO}({DATE_PATTERN})", rf"(?i)({DATE_PATTERN})"
    is_range, opens = clean.rlike(ranged), clean.rlike(r"(?i)\b(?:start|open|from)\b")
    strip = lambda x: nullif_empty(F.regexp_replace(collapsed(x), r"^[ ;,.]+|[ ;,.]+$", ""))
    return F.struct(
        F.when(is_range, strip(F.regexp_extract(clean, ranged, 1))).when(opens, strip(F.regexp_extract(clean, single, 1))).alias("open_date"),
        F.when(is_range, strip(F.regexp_extract(clean, ranged, 2))).when(~opens, strip(F.regexp_extract(clean, single, 1))).alias("deadline"),
        _cut(clean, r"(?i)\b(first[- ]round|main round|early round|regular round|rolling)\b", 1).alias("round"),
        _cut(clean, r"(?i)\b(JUPAS|Non-JUPAS|International|Mainland|Senior Year|Local|Non-local)\b", 1).alias("applicant_group"),
        _cut(clean, r"(?i)\b((?:Sept(?:ember)?|Jan(?:uary)?|Aug(?:ust)?)\s+[0-9]{4}\s+Entry)\b", 1).alias("intake"),
    )


def typed_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("d MMMM yyyy")))


def currency(code: Column, context: Column) -> Column:
    upper, lower = F.upper(code), F.lower(context)
    dollars = F.when(contains_any(lower, ("hong kong", "hkd", "hk$")), "HKD").when(contains_any(lower, ("singapore", "sgd", "s$")), "SGD").otherwise("unknown")
    return F.when(upper.isin("HKD", "HK$"), "HKD").when(upper.isin("SGD", "S$"), "SGD").when(upper.isin("USD", "US$"), "USD").when(upper == "$", dollars).otherwise(upper)


def student_group(context: Column) -> Column:
    lower = F.lower(context)
    abroad = contains_any(lower, ("non-local", "international"))
    stem = F.when(lower.contains("non-stem"), "non-local non-STEM").when(lower.contains("stem"), "non-local STEM").otherwise("non-local")
    return F.when(abroad, stem).when(contains_any(lower, ("local", "singapore citizen")), "local").when(lower.contains("permanent resident"), "permanent resident")


def billing_period(context: Column) -> Column:
    lower = F.lower(context)
    return F.when(lower.contains("per academic year"), "per academic year").when(lower.contains("per annum"), "per annum").when(contains_any(lower, ("per year", "annual")), "per year").when(lower.contains("semester"), "per semester")


def fee_type(context: Column) -> Column:
    lower = F.lower(context)
    return F.when(lower.contains("application fee"), "application_fee").when(lower.contains("tuition"), "tuition").when(lower.contains("miscellaneous"), "miscellaneous_fee").otherwise("fee")


def fee_snippet(text: Column) -> Column:
    return nullif_empty(F.trim(F.regexp_extract(text, FEE_PATTERN, 1)))


def fee_table_reference(url: Column, title: Column, text: Column) -> Column:
    """Headings of fee tables on undergraduate pages, joined by full stops."""
    hint = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit(""))))
    about = F.lower(url).contains("/admissions/undergraduate/") | F.lower(F.substring(text, 1, 2500)).contains("undergraduate")
    heads = F.array(*(nullif_empty(collapsed(F.regexp_extract(collapsed(text), p, 0))) for p in R.FEE_TABLE_PATTERNS))
    found = F.array_distinct(F.filter(heads, lambda h: h.isNotNull()))
    return F.when(~contains_any(hint, R.FEE_TABLE_NOT) & about, nullif_empty(F.array_join(found, ". ")))


def fee(url: Column, title: Column, text: Column) -> Column:
    """What a page says of fees: a sentence with a price; one without a number gives way to the headings of fee tables."""
    snippet = fee_snippet(text)
    bare = contains_any(F.lower(snippet), ("tuition", "fee", "fees", "application fee")) & ~snippet.rlike(R.FEE_NUMBER_PATTERN)
    return collapsed(F.when(snippet.isNotNull() & ~bare, snippet).otherwise(fee_table_reference(url, title, text)))


def academic_year(context: Column) -> Column:
    found = F.regexp_extract(context, R.FEE_YEAR_PATTERN, 1)
    return nullif_empty(F.replace(F.regexp_replace(found, r"\s+", ""), F.lit("-"), F.lit("/")))


def cohort(context: Column) -> Column:
    return nullif_empty(collapsed(F.regexp_extract(context, R.COHORT_PATTERN, 1)))


def _priced(text: str | None) -> list[dict]:
    """Amounts of a text with the table cell or sentence around each, by their places."""
    text = cleaned(text or "")
    marks = [(m.start(), m.end()) for m in re.finditer(R.FEE_ROW_MARKS, text)]
    out = []
    for hit in re.finditer(MONEY_PATTERN, text):
        lo, hi = hit.span()
        begin = max([-1, *(a for a, b in marks if b <= lo)]) + 1
        end = min([a for a, _ in marks if a >= hi], default=min(len(text), hi + 220))
        row = text[begin:end].strip()
        row = row if len(row) <= 360 else text[max(0, lo - 120) : hi + 220].strip()
        out.append({"code": hit[1], "amount": int(hit[2].replace(",", "").split(".")[0]), "context": cleaned(row)})
    return out


def money(text: Column) -> Column:
    """array<struct<currency, amount, student_group, academic_year, cohort, billing_period, fee_type, raw_text>>: one for
    each amount, whole units; what is said of it comes from its cell or sentence."""
    found = F.udf(_priced, "array<struct<code:string,amount:bigint,context:string>>", useArrow=True)(text)
    return F.transform(
        found,
        lambda m: F.struct(
            currency(m["code"], m["context"]).alias("currency"),
            m["amount"].alias("amount"),
            student_group(m["context"]).alias("student_group"),
            academic_year(m["context"]).alias("academic_year"),
            cohort(m["context"]).alias("cohort"),
            billing_period(m["context"]).alias("billing_period"),
            fee_type(m["context"]).alias("fee_type"),
            m["context"].alias("raw_text"),
        ),
    )


def programme_names(text: Column) -> Column:
    """Distinct award names (case apart) in their order, up to a verb or the end of the clause."""
    pattern = PROGRAMME_PATTERN
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(collapsed(n), r"^[ .;,|]+|[ .;,|]+$", ""))
    names = F.filter(names, lambda n: n.contains(" "))
    return F.filter(names, lambda n, i: ~F.exists(F.slice(names, 1, i), lambda m: F.lower(m) == F.lower(n)))


def prerequisite(text: Column) -> Column:
    """The sentence that asks for mathematics."""
    return F.coalesce(*(_cut(text, p, 1) for p in R.PREREQUISITE_PATTERNS))


def contact(url: Column, title: Column, text: Column) -> Column:
    """An e-mail address, else a phone number; none from privacy pages and contact forms."""
    head = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.substring(text, 1, 1000)))
    guarded = contains_any(head, ("/contact-us/form", "privacy", "personal information collection statement"))
    email = _cut(text, r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,})", 1)
    phone = nullif_empty(F.trim(F.regexp_extract(text, r"(?i)(?:phone|tel)[:\s]+([+()0-9][+()0-9\-\s]{5,})", 1)))
    return F.when(~guarded, F.coalesce(email, phone))


def contact_snippet(text: Column, value: Column) -> Column:
    return F.coalesce(sentence_with(text, value), value)


def keyword_sentence(text: Column, words: str) -> Column:
    """From a keyword to the next full stop."""
    return nullif_empty(collapsed(F.regexp_extract(text, rf"(?i)((?:{words})[^.]*\.)", 1)))
