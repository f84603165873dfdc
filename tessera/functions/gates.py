"""Context gates, page categories, blocked-page detection and source strategies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import contains_any, count_contained


def _spaced(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def _head(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def undergraduate_context(url: Column, title: Column, text: Column) -> Column:
    path, named = F.lower(U.path(url)), _spaced(title, _head(text, 1200))
    explicit = contains_any(path, R.EXPLICIT_UNDERGRAD_PATH_HINTS)
    topical = contains_any(path, R.ADMISSIONS_TOPIC_PATHS)
    level = contains_any(named, R.UNDERGRADUATE_LEVEL_TERMS)
    phrase = F.lower(F.coalesce(title, F.lit(""))).contains("undergraduate admissions") | F.lower(_head(text, 1200)).contains("undergraduate admissions")
    general = F.lower(url).contains("admissions") & named.contains("undergraduate")
    return F.when(explicit, True).when(contains_any(path, R.NON_ADMISSIONS_PATH_HINTS), False).otherwise((topical & level) | phrase | general)


def fee_context(url: Column, title: Column, text: Column) -> Column:
    place = F.concat_ws(" ", url, F.lower(F.coalesce(title, F.lit(""))), F.lower(U.path(url)))
    other = contains_any(place, R.FEE_CONTEXT_NOT)
    return undergraduate_context(url, title, text) & ~other & contains_any(_spaced(url, title, _head(text, 1800)), R.FEE_CONTEXT_TERMS)


def scholarship_context(url: Column, title: Column, text: Column) -> Column:
    hay = _spaced(url, title, _head(text, 1800))
    return undergraduate_context(url, title, text) & ~contains_any(hay, R.SCHOLARSHIP_CONTEXT_NOT) & contains_any(hay, R.SCHOLARSHIP_CONTEXT_TERMS)


def contact_context(url: Column, title: Column, text: Column) -> Column:
    hay = _spaced(url, title, _head(text, 1600))
    other = contains_any(hay, R.CONTACT_CONTEXT_NOT)
    return undergraduate_context(url, title, text) & ~other & contains_any(hay, R.CONTACT_CONTEXT_TERMS)


def english_context(url: Column, title: Column, text: Column) -> Column:
    hay = _spaced(url, title, _head(text, 2500))
    return undergraduate_context(url, title, text) & ~contains_any(hay, R.ENGLISH_FALSE_POSITIVE_HINTS) & contains_any(hay, R.ENGLISH_REQUIREMENT_TEXT_HINTS)


def is_challenge(url: Column, title: Column, text: Column) -> Column:
    """A bot or firewall page instead of the source."""
    named, head = _spaced(url, title), F.lower(_head(text, 4000))
    robots = head.contains("noindex") & head.contains("nofollow") & contains_any(head, ("robots", "<meta"))
    incident = head.contains("request unsuccessful") & contains_any(head, ("incident id", "_incapsula_resource"))
    script = (F.length(head) <= 2500) & contains_any(head, ("<iframe", "<script")) & contains_any(head, ("_incapsula_resource", "challenge", "captcha"))
    return contains_any(named, R.CHALLENGE_URL_TERMS) | contains_any(head, R.CHALLENGE_TEXT_TERMS) | robots | incident | script


def source_strategy(source_type: Column, url: Column, title: Column, text: Column, category: Column) -> Column:
    portal = contains_any(_spaced(url, title), R.PORTAL_TERMS) | contains_any(F.lower(_head(text, 1200)), R.PORTAL_TEXT_TERMS)
    return F.when(is_challenge(url, title, text), "blocked_or_challenge").when(portal, "application_portal").when(source_type == "pdf", "pdf_document").when(source_type == "json", "json_api").when(category == "irrelevant", "irrelevant").when(source_type == "html", "html_page").otherwise("other")


def category_scores(url: Column, title: Column, text: Column, years: tuple[str, ...] = ("2026", "2027", "2028")) -> dict[str, Column]:
    hay, lower_url, lower_title = _spaced(url, title, text), F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    out = {}
    for category, words in R.CATEGORY_KEYWORDS.items():
        slugs = [w.replace(" ", "-") for w in words] + [w.replace(" ", "_") for w in words]
        score = count_contained(hay, words) + F.when(contains_any(lower_title, words), 2).otherwise(0) + F.when(contains_any(lower_url, slugs), 1).otherwise(0)
        if category == "international_requirements":
            score = score + F.when(hay.contains("english") & english_context(url, title, text), 1).otherwise(0)
        if category == "application_deadlines":
            score = score + F.when(contains_any(hay, years), 1).otherwise(0)
        if category == "programme_prerequisites":
            score = score + F.when(lower_url.contains("pdf"), 1).otherwise(0)
        out[category] = score.cast("int")
    return out


def classified(url: Column, title: Column, text: Column) -> Column:
    """struct<category, score>: the first category with the greatest score; irrelevance rules come first."""
    hay, lower_url, lower_title = _spaced(url, title, text), F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    negatives = count_contained(hay, R.CLASSIFIER_NEGATIVE)
    strong = contains_any(lower_url, R.STRONG_ADMISSIONS_SIGNALS) | contains_any(lower_title, R.STRONG_ADMISSIONS_SIGNALS)
    news = lower_title.contains("news") & ~contains_any(lower_title, R.NEWS_EXCEPTION_TERMS)
    off = (negatives > 0) & ~strong & F.when(contains_any(lower_url, R.STRONG_IRRELEVANT_PATHS) | news, True).when(contains_any(hay, R.ADMISSIONS_PAGE_TERMS), False).otherwise(negatives >= 3)
    elsewhere = contains_any(_spaced(url, title), R.CONTEXTUAL_IRRELEVANT_TERMS)
    scores = category_scores(url, title, text)
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, s) in enumerate(scores.items())))
    best = F.array_max(ranked)
    row = lambda category, score: F.struct(category.alias("category"), score.cast("int").alias("score"))
    nothing = F.lit("irrelevant")
    return F.when(off, row(nothing, -negatives)).when(elsewhere & ~undergraduate_context(url, title, text), row(nothing, F.lit(0))).when(best["score"] > 0, row(best["category"], best["score"])).otherwise(row(nothing, F.lit(0)))


def low_confidence(score: Column, threshold: int = 1) -> Column:
    return score.between(0, threshold)
