"""URL functions on the RFC 3986 parts, as columns. None of them raises on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import bound, contains_any, ends_with_any
from tessera.functions.rules import (
    DISALLOWED_SOURCE_PLAN_HOST_TERMS,
    DISALLOWED_SOURCE_PLAN_PATH_TERMS,
    DISALLOWED_SOURCE_PLAN_PORTAL_TERMS,
    LOW_VALUE_DOCUMENT_TERMS,
    SENSITIVE_QUERY_KEYS,
    SITEMAP_PROBE_PATHS,
    STATIC_RESOURCE_SUFFIXES,
    TRACKING_QUERY_NAMES,
    TRACKING_QUERY_PREFIXES,
)

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.regexp_extract(url, _PARTS, n)


def path(url: Column) -> Column:
    """The path without parameters of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def normal_host(authority: Column) -> Column:
    """Lower case, without user information and default ports."""
    host = F.regexp_replace(F.lower(F.trim(authority)), r"^.*@", "")
    return F.regexp_replace(host, r"^([^:]*):(?:80|443)$", "$1")


def host(url: Column) -> Column:
    return normal_host(part(url, 2))


def registrable_domain(host_: Column) -> Column:
    """The last two labels; three under a two-letter country with an academic or general second level."""
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    n = F.size(labels)
    second = F.get(labels, n - 2)
    three = (n > 2) & (F.length(F.get(labels, n - 1)) == 2) & second.isin("ac", "edu", "com", "org", "net", "gov")
    return F.array_join(F.slice(labels, F.greatest(n - F.when(three, 3).otherwise(2) + 1, F.lit(1)), F.when(three, 3).otherwise(2)), ".")


def _plus_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Decoded (k, v) in their order, blank values kept, empty parts dropped."""
    kept = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(kept, lambda p: F.struct(_plus_decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _plus_decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))


def query_map(url: Column) -> Column:
    """The query as a map; of a repeated key the last value."""
    pairs = query_pairs(part(url, 4))
    return bound(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["k"] == p["k"]))))


def encoded_query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _is_tracking(key: Column) -> Column:
    return F.lower(key).isin(*TRACKING_QUERY_NAMES) | ends_with_any(F.reverse(F.lower(key)), [p[::-1] for p in TRACKING_QUERY_PREFIXES])


def without_dots(path_: Column) -> Column:
    """A rooted path with its ``.`` and ``..`` segments resolved; above the root is the root."""
    steps = F.split(F.regexp_replace(path_, "^/", ""), "/")
    dots = F.element_at(steps, -1).isin(".", "..")

    def step(taken: Column, s: Column) -> Column:
        return F.when(s == ".", taken).when(s == "..", F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0)))).otherwise(F.array_append(taken, s))

    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    return F.when(path_.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dots & (F.size(kept) > 0), "/").otherwise(""))).otherwise(path_)


def joined(link: Column, base: Column) -> Column:
    """A link joined to its page's address (RFC 3986): absolute, of another host, rooted, of the folder, or a query."""
    own = lambda n: part(base, n)
    origin = F.concat(own(1), F.lit("://"), own(2))
    folder = F.regexp_replace(F.when(own(3) == "", "/").otherwise(own(3)), "[^/]*$", "")
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    route = part(link, 3)
    return (
        F.when(link == "", base)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(own(1), F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link))
        .when(link.startswith("/"), F.concat(origin, without_dots(route), tail))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, route)), tail))
    )


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """One spelling of a URL for de-duplication, joined to ``base`` first: no fragment, parameters, default port, user
    information, last slash or tracking names; scheme and host in lower case, query sorted and encoded anew. File
    addresses keep their path and lose the rest."""

    def of(u: Column) -> Column:
        scheme = F.lower(F.when(part(u, 1) != "", part(u, 1)).otherwise("https"))
        raw = path(u)
        cut = F.when(raw == "", "/").when(raw == "/", "/").otherwise(F.regexp_replace(raw, "/+$", ""))
        query = encoded_query(F.array_sort(F.filter(query_pairs(part(u, 4)), lambda p: ~_is_tracking(p["k"]))))
        web = F.concat(scheme, F.lit("://"), host(u), cut, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return F.when(scheme == "file", F.concat(F.lit("file://"), part(u, 2), raw)).otherwise(web)

    return of(url) if base is None else bound(joined(url, base), of)


def sitemap_probes(seed: Column) -> Column:
    """Addresses where a web site's sitemaps may be; none of another scheme."""
    origin = F.concat(F.lower(part(seed, 1)), F.lit("://"), part(seed, 2))
    web = F.lower(part(seed, 1)).isin("http", "https") & (part(seed, 2) != "")
    return F.when(web, F.array(*(canonical_url(F.concat(origin, F.lit(p))) for p in SITEMAP_PROBE_PATHS))).otherwise(F.array().cast("array<string>"))


def _lower_path(url: Column) -> Column:
    """Percent-decoded; a plus stays a plus."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url)))


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_static(url: Column) -> Column:
    return ends_with_any(_lower_path(url), STATIC_RESOURCE_SUFFIXES)


def is_low_value(url: Column) -> Column:
    return is_static(url) | (is_pdf(url) & contains_any(_lower_path(url), LOW_VALUE_DOCUMENT_TERMS))


def is_allowed(url: Column, seed_host: str, seed_domain: str, hosts: list[str] | None = None, domains: list[str] = (), subdomains: bool = True) -> Column:
    """Official-domain policy: an allowed host (by default the seed's), an allowed domain, or, with ``subdomains``, the
    seed's own registrable domain. File addresses are allowed where ``file`` is an allowed host."""
    allowed = [seed_host] if hosts is None else list(hosts)
    h, d = host(url), registrable_domain(host(url))
    known = h.isin(*allowed)
    if subdomains:
        known = known | (d == seed_domain)
    if domains:
        known = known | h.isin(*domains) | d.isin(*domains)
    scheme = F.lower(part(url, 1))
    return F.when(scheme == "file", F.lit("file" in allowed)).otherwise(scheme.isin("http", "https") & (h != "") & known)


def planner_reason(url: Column, allowed: Column) -> Column:
    """Why a suggested URL is refused, or ``accepted``."""
    p, keys = _lower_path(url), F.transform(query_pairs(part(url, 4)), lambda q: q["k"])
    return (
        F.when(F.lower(part(url, 1)) != "https", "non_https")
        .when(~allowed, "outside_allowed_domain")
        .when(contains_any(host(url), DISALLOWED_SOURCE_PLAN_HOST_TERMS), "social_or_forum_url")
        .when(contains_any(p, DISALLOWED_SOURCE_PLAN_PATH_TERMS), "tracking_or_redirect_url")
        .when(contains_any(p, DISALLOWED_SOURCE_PLAN_PORTAL_TERMS), "portal_or_login_url")
        .when(F.exists(keys, _is_tracking), "tracking_or_redirect_url")
        .when(is_low_value(url), "low_value_source_url")
        .otherwise("accepted")
    )


def _plain_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def has_sensitive_query(url: Column) -> Column:
    return F.exists(query_pairs(part(url, 4)), lambda p: _plain_key(p["k"]).isin(*SENSITIVE_QUERY_KEYS))


def _with_query(url: Column, pairs: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), part(url, 3), F.lit("?"), encoded_query(pairs))


def with_query_value(url: Column, key: Column | str, value: Column) -> Column:
    """Every value of ``key`` replaced, or the pair appended."""
    pairs, key = query_pairs(part(url, 4)), F.lit(key) if isinstance(key, str) else key
    new = F.struct(key.alias("k"), value.cast("string").alias("v"))
    edited = F.when(F.exists(pairs, lambda p: p["k"] == key), F.transform(pairs, lambda p: F.when(p["k"] == key, new).otherwise(p))).otherwise(F.concat(pairs, F.array(new)))
    return _with_query(url, edited)


def with_query_pairs(url: Column, values: Column) -> Column:
    """Pairs (k, v) of distinct keys: the first value of each key replaced, the other pairs appended."""
    pairs = query_pairs(part(url, 4))
    taken = lambda k: F.exists(pairs, lambda p: p["k"] == k)
    first = lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda e: e["k"] == p["k"])
    edited = F.transform(pairs, lambda p, i: F.coalesce(F.when(first(p, i), F.get(F.filter(values, lambda v: v["k"] == p["k"]), 0)), p))
    return _with_query(url, F.concat(edited, F.filter(values, lambda v: ~taken(v["k"]))))


def query_key(url: Column, *keys: str) -> Column:
    """The first key of the query whose plain form is one of these, as it is written."""
    return F.get(F.filter(query_pairs(part(url, 4)), lambda p: _plain_key(p["k"]).isin(*keys)), 0)["k"]


def same_query_key(url: Column, key: Column) -> Column:
    """The first key of the query with the plain form of ``key``."""
    return F.get(F.filter(query_pairs(part(url, 4)), lambda p: _plain_key(p["k"]) == _plain_key(key)), 0)["k"]


def first_int(url: Column, key: Column) -> Column:
    """The first value of exactly this key, if it is a whole number."""
    value = F.get(F.filter(query_pairs(part(url, 4)), lambda p: p["k"] == key), 0)["v"]
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(value).try_cast("long"))


def int_query_value(url: Column, *keys: str) -> Column:
    found = F.filter(query_pairs(part(url, 4)), lambda p: _plain_key(p["k"]).isin(*keys))
    return F.get(found, 0)["v"].try_cast("long")


def page_group_url(url: Column) -> Column:
    """The URL without its paging keys: what pages of one endpoint share."""
    kept = F.filter(query_pairs(part(url, 4)), lambda p: ~_plain_key(p["k"]).isin("page", "pagenumber", "offset", "skip", "cursor", "after"))
    query = encoded_query(kept)
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def source_family(url: Column) -> Column:
    """Host and the first two path segments."""
    segments = F.slice(F.filter(F.split(part(url, 3), "/"), lambda s: s != ""), 1, 2)
    return F.array_join(F.concat(F.array(host(url)), segments), "/")


def source_type(url: Column, content_type: Column) -> Column:
    c = F.lower(content_type)
    return F.when((c == "application/pdf") | is_pdf(url), "pdf").when(c.isin("text/html", "application/xhtml+xml"), "html").when(c.isin("application/json", "application/ld+json") | F.lower(path(url)).endswith(".json"), "json").otherwise("other")
