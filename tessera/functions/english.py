"""English test scores and requirements.

Scores are read from the clause around each mention of a test, and requirements from the text around it, both by their
places in the text, which regular expressions of Spark don't give: so these two are Arrow UDFs.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.columns import nullif_empty
from tessera.functions.text import collapsed

TESTS = "array<struct<test_name:string,overall_score:string,component_scores:map<string,string>,raw_text:string,rule_type:string>>"
_DELIMITERS = re.compile(r" or |;|\[back to top\]|(?<![0-9])\.|\.(?![0-9])", re.I)


def cleaned(text: str) -> str:
    """Entities resolved, single blanks, no blanks or marks at the ends."""
    return re.sub(r"\s+", " ", html.unescape(text).replace("\xa0", " ")).strip(" ;,.")


def _number(text: str) -> str:
    """6 and 06 are one number, 6.0 is another."""
    return str(int(text)) if text.isdigit() else text


def _score(test: str, clause: str) -> dict | None:
    """What a clause says about a test, if it says a score."""
    clause = cleaned(clause)
    lower = clause.lower()
    if any(t in lower for t in R.ENGLISH_SCORE_TERMS):
        stated = re.search("[0-9]", clause)
    else:
        stated = "grade" in lower and re.search(r"\b[A-E][0-9]?\b", clause)
    if not stated:
        return None
    fill = {"{q}": R.ENGLISH_QUALIFIER, "{n}": R.ENGLISH_NUMBER, "{t}": re.escape(test.split()[0])}
    overall = None
    for pattern in R.ENGLISH_SCORE_PATTERNS:
        for k, v in fill.items():
            pattern = pattern.replace(k, v)
        if hit := re.search(pattern, clause, re.I):
            overall = _number(hit[1])
            break
    parts = {c: _number(hit[1].strip()) for c in R.ENGLISH_COMPONENTS if (hit := re.search(R.ENGLISH_COMPONENT_PATTERN.replace("{c}", c), clause, re.I))}
    if hit := re.search(R.ENGLISH_SUBTEST_PATTERN, clause, re.I):
        parts["minimum_component"] = _number(hit[1])
    if overall is None and not parts:
        return None
    return {"test_name": test, "overall_score": overall, "component_scores": parts, "raw_text": clause, "rule_type": None}


def tests_in(text: str) -> list[dict]:
    """Scores of tests, or the one rule of an exemption."""
    text = cleaned(text)
    lower = text.lower()
    if any(t in lower for t in R.ENGLISH_EXEMPTION_TERMS) and any(t in lower for t in R.ENGLISH_EXEMPTION_SUBJECTS):
        return [{"test_name": None, "overall_score": None, "component_scores": {}, "raw_text": text, "rule_type": "exemption_or_waiver"}]
    cuts = [m.span() for m in _DELIMITERS.finditer(text)]
    found = []
    for test, pattern in R.ENGLISH_TESTS:
        for hit in re.finditer(pattern, text, re.I):
            lo, hi = hit.span()
            clause = text[max([0, *(b for _, b in cuts if b <= lo)]) : min([len(text), *(a for a, _ in cuts if a >= hi)])]
            score = _score(test, clause)
            if score is None and len(clause) < hi - lo + 12:  # hardly more than the name: look further
                score = _score(test, text[max(0, lo - 80) : hi + 120])
            if score and score not in found:
                found.append(score)
    return found


def _snippet(text: str) -> str | None:
    """The surroundings of a mention with most scores, the shortest of these; else the first sentence of a requirement."""
    around = [re.sub(r"\s+", " ", text[max(0, m.start() - 260) : m.end() + 620]).strip() for m in re.finditer(R.ENGLISH_MENTION_PATTERN, text, re.I)]
    scored = [(-len(tests), len(s), k, s) for k, s in enumerate(around) if (tests := tests_in(s))]
    if scored:
        return min(scored)[3]
    for pattern in R.ENGLISH_SNIPPET_PATTERNS:
        if hit := re.search(pattern.replace("{s}", R.ENGLISH_SAFE_TEXT), text, re.I):
            return re.sub(r"\s+", " ", hit[0]).strip()
    return None


def _requirement(text: str | None) -> dict | None:
    if not text or not re.search(R.ENGLISH_TRIGGER_PATTERN, text.lower()):
        return None
    snippet = _snippet(text)
    if not snippet or len(snippet) > 900:
        return None
    tests = tests_in(snippet)
    if not tests or any(t in snippet.lower() for t in R.ENGLISH_HARD_FALSE_TERMS):
        return None
    return {"value": "; ".join(dict.fromkeys(t["raw_text"] for t in tests if t["raw_text"])), "tests": tests}


def english_tests(text: Column) -> Column:
    """Scores of a requirement's text; empty where it states none."""
    return F.udf(lambda t: tests_in(t) if t else [], TESTS, useArrow=True)(text)


def english_requirement(text: Column) -> Column:
    """struct<value, tests> of the requirement that a text states with scores or an exemption, else null. Mentions
    without scores, and lists of departments and links, aren't requirements."""
    return F.udf(_requirement, f"struct<value:string,tests:{TESTS}>", useArrow=True)(text)


def looks_like_list(snippet: Column) -> Column:
    """Whether a snippet is a list of programmes or links that mentions English."""
    lower = F.lower(snippet)
    hard = F.exists(F.array(*map(F.lit, R.ENGLISH_HARD_FALSE_TERMS)), lambda t: lower.contains(t))
    return hard | (F.regexp_count(lower, F.lit(" bachelor ")) >= 2) | (F.regexp_count(lower, F.lit(" programme ")) >= 5)


def accepted_qualification(text: Column) -> Column:
    """The first sentence that says which qualifications are accepted."""
    return F.coalesce(*(nullif_empty(collapsed(F.regexp_extract(text, p, 1))) for p in R.QUALIFICATION_PATTERNS))
