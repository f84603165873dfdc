"""Relevance scores of a URL with title and text, and the signals that explain them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import contained, contains_any, count_contained, joined


def _off_topic(path: Column) -> Column:
    return contains_any(path, R.NON_ADMISSIONS_PATH_HINTS) & ~contains_any(path, R.UNDERGRAD_ADMISSIONS_PATH_HINTS)


def _endpoint(path: Column) -> Column:
    return path.endswith(".json") | path.contains("/api/")


def rule_score(url: Column, title: Column, text: Column) -> Column:
    hay, path = joined(url, title, text), F.lower(U.path(url))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        2 * count_contained(hay, R.POSITIVE_KEYWORDS)
        - 3 * count_contained(hay, R.NEGATIVE_KEYWORDS)
        + points(_off_topic(path), -12)
        + points(contains_any(path, R.ADMISSIONS_SCORE_PATHS), 6)
        + points(contains_any(path, R.PROGRAMME_SOURCE_PATH_HINTS), 6)
        + points(contains_any(path, R.PATH_NOISE_HINTS), -8)
        + points(U.is_pdf(url) & contains_any(hay, R.PDF_SCORE_TERMS), 4)
        + points(_endpoint(path), 3)
        + points(U.is_low_value(url), -100)
    ).cast("int")


def _profile_hits(url: Column, title: Column, text: Column) -> tuple[Column, Column, Column]:
    hay, path = joined(url, title, text), F.lower(U.path(url))
    good = F.array_distinct(F.concat(contained(path, R.ADMISSIONS_PROGRAMME_PATH_HINTS), contained(hay, R.ADMISSIONS_PROGRAMME_TEXT_HINTS)))
    noise = F.array_distinct(F.concat(contained(path, R.ADMISSIONS_PROGRAMME_NOISE_HINTS), contained(hay, R.ADMISSIONS_PROGRAMME_TEXT_NOISE_HINTS)))
    catalogue = contains_any(path, R.PROGRAMME_SOURCE_PATH_HINTS) & ~contains_any(path, ("/summer", "/pre-university", "/preuniversity"))
    return good, noise, catalogue


def profile_score(url: Column, title: Column, text: Column) -> Column:
    good, noise, catalogue = _profile_hits(url, title, text)
    extra = F.when(catalogue, 8).otherwise(0) + F.when(_off_topic(F.lower(U.path(url))), -12).otherwise(0)
    return (rule_score(url, title, text) + 5 * F.size(good) - 8 * F.size(noise) + extra).cast("int")


@dataclass(frozen=True)
class KeywordPlan:
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    url_hints: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()


def keyword_plan(query: str, most: int = 500) -> KeywordPlan:
    """Distinct lower-case terms in their order, and the path hints of every listed term that they hold."""
    import re

    query = query.strip()
    if len(query) > most:
        raise ValueError(f"a keyword query has at most {most} characters")
    terms = tuple(dict.fromkeys(t.lower() for t in re.split(r"[\s,;|/]+", query) if t))
    hints = dict.fromkeys(h for t in terms for listed, own in R.KEYWORD_URL_HINTS if listed in t for h in own)
    return KeywordPlan(terms, (), tuple(hints), () if terms else ("empty_keyword_query",))


def keyword_score(plan: KeywordPlan, url: Column, title: Column, text: Column) -> Column:
    """The rule score with 4 for each term whose tokens all occur, -5 for negative ones and 3 for path hints."""
    import re

    tokens, path = F.regexp_extract_all(joined(url, title, text), F.lit("[a-z0-9]+"), F.lit(0)), F.lower(U.path(url))
    total = rule_score(url, title, text)
    for terms, weight in ((plan.positive, 4), (plan.negative, -5)):
        for term in terms:
            own = re.findall("[a-z0-9]+", term.lower())
            if own:
                held = F.size(F.array_except(F.array(*map(F.lit, own)), tokens)) == 0
                total = total + F.when(held, weight).otherwise(0)
    return (total + 3 * count_contained(path, [h.lower() for h in plan.url_hints])).cast("int")


def rule_signals(url: Column, title: Column, text: Column) -> Column:
    hay, path = joined(url, title, text), F.lower(U.path(url))
    none = F.array().cast("array<string>")
    one = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(none)
    return F.array_distinct(
        F.concat(
            contained(hay, R.POSITIVE_KEYWORDS, "positive_keyword:"),
            contained(hay, R.NEGATIVE_KEYWORDS, "negative_keyword:"),
            F.when(_off_topic(path), contained(path, R.NON_ADMISSIONS_PATH_HINTS, "non_admissions_path:")).otherwise(none),
            contained(path, R.PATH_RELEVANCE_HINTS, "path_relevance_hint:"),
            contained(path, R.PROGRAMME_SOURCE_PATH_HINTS, "programme_source_path_hint:"),
            contained(path, R.PATH_NOISE_HINTS, "path_noise_hint:"),
            one(U.is_pdf(url) & contains_any(hay, R.PDF_SCORE_TERMS), "pdf_admissions_hint"),
            one(_endpoint(path), "api_endpoint_hint"),
        )
    )


def _prefixed(terms: Column, prefix: str) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(prefix), t))


def profile_signals(url: Column, title: Column, text: Column) -> Column:
    """The rules' signals and those of the default profile."""
    good, noise, catalogue = _profile_hits(url, title, text)
    source = F.when(catalogue, F.array(F.lit("profile_programme_catalog_source"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(rule_signals(url, title, text), _prefixed(good, "profile_positive:"), _prefixed(noise, "profile_noise:"), source))


def keyword_signals(plan: KeywordPlan, url: Column, title: Column, text: Column) -> Column:
    """The rules' signals and those of a keyword plan."""
    import re

    tokens, path = F.regexp_extract_all(joined(url, title, text), F.lit("[a-z0-9]+"), F.lit(0)), F.lower(U.path(url))

    def held(terms: tuple[str, ...], prefix: str) -> Column:
        own = [(t, re.findall("[a-z0-9]+", t.lower())) for t in terms]
        found = [F.when(F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0, F.lit(prefix + t)) for t, words in own if words]
        return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")

    hints = F.filter(F.array(*(F.when(path.contains(h.lower()), F.lit(f"keyword_plan_url_hint:{h}")) for h in plan.url_hints)), lambda x: x.isNotNull()) if plan.url_hints else F.array().cast("array<string>")
    return F.array_distinct(F.concat(rule_signals(url, title, text), held(plan.positive, "keyword_plan_positive:"), held(plan.negative, "keyword_plan_negative:"), hints))


def strategy(name: str, query: str | None = None):
    """The score builder of a strategy name or one of its aliases."""
    known = R.RELEVANCE_STRATEGY_ALIASES.get(name)
    if known is None:
        raise ValueError(f"unknown relevance strategy: {name}")
    if known == "rule-based":
        return rule_score
    if known == "admissions-programme":
        return profile_score
    if not query:
        raise ValueError("this strategy needs a keyword query")
    plan = keyword_plan(query)
    return lambda url, title, text: keyword_score(plan, url, title, text)


def should_follow(url: Column, allowed: Column) -> Column:
    none = F.lit(None).cast("string")
    return allowed & ~U.is_low_value(url) & (rule_score(url, none, none) >= -2)
