"""HTML and plain-text functions as columns."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import bound, nullif_empty

#: Characters of named entities, with and without the semicolon; those of numbers whose meaning is that of windows-1252.
_COMMON = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;", "ndash;", "mdash;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "copy;", "middot;", "bull;", "hellip;", "eacute;")  # looked up first
_NAMED = {n: html5[n] for n in _COMMON} | html5
_LEGACY = "|".join(sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True))
_WINDOWS = {str(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"}
_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_LEGACY}))"
_ENDED = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def _value_of(name: Column, values: dict[str, str]) -> Column:
    """The value of a name in a constant list, else null. The list is one text that is searched: thousands of literals
    take seconds to hand over, and a map made of a text is parsed anew for every entity."""
    listed = F.lit("\x01" + "".join(f"{k}\x02{v}\x01" for k, v in values.items()))
    key = F.concat(F.lit("\x01"), name, F.lit("\x02"))
    return bound(F.position(key, listed), lambda at: F.when(at > 0, F.substring_index(F.substr(listed, at + F.length(key), F.lit(8)), "\x01", 1)))


def _code_point(number: Column) -> Column:
    """The character of a decimal code point; the replacement character where there is none."""
    code = number.try_cast("long")
    known = _value_of(code.cast("string"), _WINDOWS)
    fits = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    hidden = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0xB) | ((code % 0x10000) >= 0xFFFE)
    return F.when(known.isNotNull(), known).when(~fits, F.lit("\ufffd")).when(hidden, F.lit("")).otherwise(plain)


def _resolved(entity: Column, ended: bool) -> Column:
    number = F.regexp_extract(entity, "^&#([0-9]+)", 1)
    hexed = F.regexp_extract(entity, "^&#[xX]([0-9A-Fa-f]+)", 1)
    name = F.substring(entity, 2, 64)
    lead = F.regexp_extract(name, f"^({_LEGACY})", 1)
    whole = _value_of(name, _NAMED)
    part = entity if ended else F.when(lead != "", F.concat(_value_of(lead, _NAMED), F.substr(name, F.length(lead) + 1))).otherwise(entity)
    return F.when(number != "", _code_point(number)).when(hexed != "", _code_point(F.conv(hexed, 16, 10))).otherwise(F.coalesce(whole, part))


def _interleaved(between: Column, found: Column) -> Column:
    """What stands between finds, with the finds in their places; these are computed once, not once for each place."""
    return bound(found, lambda f: F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(f, i), F.lit("")))), ""))


def unescaped(text: Column, ended: bool = False) -> Column:
    """Entities resolved, by name or number; one pass, so that doubly escaped ones stay escaped once. ``ended``: only
    those that a semicolon ends; what a cut has left of one stays as it is."""
    entity = _ENDED if ended else _ENTITY

    def of(t: Column) -> Column:
        between = F.split(t, entity, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(f"({entity})"), F.lit(1)), lambda e: _resolved(e, ended))
        return F.when(t.contains("&"), _interleaved(between, found)).otherwise(t)

    return bound(text, of)


def without_tags(html: Column, ended: bool = False) -> Column:
    return unescaped(F.regexp_replace(html, "<[^>]+>", " "), ended)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def main_fragment(html: Column, ended: bool = False) -> Column:
    """The first of main, article or a content block with at least 80 characters of text, else all."""
    patterns = (
        r"(?is)<main\b[^>]*>(.*?)</main>",
        r"(?is)<article\b[^>]*>(.*?)</article>",
        r"(?is)<(?:div|section)\b[^>]*(?:role|id|class)\s*=\s*[\"'][^\"']*(?:main|content|page-content|body-content)[^\"']*[\"'][^>]*>(.*?)</(?:div|section)>",
    )
    found = [F.when(F.length(F.trim(without_tags(f := F.regexp_extract(html, p, 1), ended))) >= 80, f) for p in patterns]
    return F.coalesce(*found, html)


def without_noise(html: Column) -> Column:
    """Comments, page furniture and blocks whose attributes name furniture, until nothing more goes."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in R.DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    block = rf"(?is)<(?<tag>div|section|form|ul|ol)\b[^>]*(?:class|id|role|aria-label)\s*=\s*[\"'][^\"']*(?:{R.NOISE_ATTRIBUTE_PATTERN})[^\"']*[\"'][^>]*>.*?</\k<tag>>"

    def settled(t: Column) -> Column:
        """Each pass takes a block at least, so there are no more passes than blocks; the rest of them does nothing."""
        state = lambda text, go: F.struct(text.alias("text"), go.alias("go"))
        step = lambda s, _: F.when(s["go"], bound(F.regexp_replace(s["text"], block, " "), lambda new: state(new, new != s["text"]))).otherwise(s)
        blocks = F.regexp_count(t, F.lit(r"(?i)<(?:div|section|form|ul|ol)\b"))
        return F.aggregate(F.sequence(F.lit(0), blocks), state(t, F.lit(True)), step, lambda s: s["text"])

    return bound(out, settled)


def table_text(table: Column, ended: bool = False) -> Column:
    """Cells joined by a bar, rows by a full stop; empty cells and rows are left out."""

    def row(r: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: collapsed(without_tags(c, ended)))
        return F.array_join(F.filter(cells, lambda c: c != ""), " | ")

    rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), row)
    return F.array_join(F.filter(rows, lambda r: r != ""), " . ")


def with_flat_tables(html: Column, ended: bool = False) -> Column:
    """Every table replaced by its text: what stands between tables, with the tables' texts in their places."""

    def flat(h: Column) -> Column:
        between = F.split(h, r"(?is)<table\b[^>]*>.*?</table>", -1)
        tables = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1)), lambda t: table_text(t, ended))
        return _interleaved(between, tables)

    return bound(html, flat)


def html_text(html: Column, ended: bool = False) -> Column:
    return collapsed(without_tags(with_flat_tables(without_noise(main_fragment(html, ended)), ended), ended))


def title(html: Column, ended: bool = False) -> Column:
    pick = lambda tag: nullif_empty(collapsed(without_tags(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), ended)))
    return F.coalesce(pick("title"), pick("h1"))


def academic_year(text: Column) -> Column:
    return nullif_empty(F.replace(F.regexp_extract(text, r"(?i)\b(?:academic year|ay)[:\s]+([0-9]{4}[/-][0-9]{4})", 1), F.lit("-"), F.lit("/")))


def links(html: Column) -> Column:
    """Targets of links in their order, without mail, phone and script ones."""
    found = F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(found, lambda x: ~F.lower(x).rlike("^(?:mailto|tel|javascript):"))


def absolute(link: Column, base: Column) -> Column:
    return U.joined(link, base)


def sitemap_locations(xml: Column) -> Column:
    """Distinct ``loc`` values in their order; malformed XML gives what can be read."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: unescaped(x)))


def sitemap_urls(xml: Column, base: Column) -> Column:
    """Distinct canonical addresses of a sitemap, joined to its own, in their order."""
    return F.array_distinct(F.transform(sitemap_locations(xml), lambda u: U.canonical_url(u, base)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def sentence_with(text: Column, needle: Column) -> Column:
    return F.trim(F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains(F.lower(needle))), 0))
