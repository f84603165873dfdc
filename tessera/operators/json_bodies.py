"""JSON answers of catalogue endpoints: objects, links, claims, programme rows, diagnostics, paging and filters.

An Arrow UDF walks each body once, since the order of keys is part of the rules and Spark's own JSON and variant types
don't keep it; everything that is decided about what it finds is a column expression. A body is bounded by the capture
limit, and so is what is found in it.

Defined cases: null, empty and invalid bodies have no objects and are ``invalid_json``; of repeated keys the last counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import bound, contains_any, nullif_empty
from tessera.operators.catalogue import REVIEW, clean, mode_of

OBJECT = "struct<nth:int,kinds:map<string,string>,texts:map<string,string>,items:map<string,array<string>>,listed:string,compact:string,scalars:string>"
FACTS = "struct<valid:boolean,total:bigint,top:array<struct<k:string,v:bigint>>,paged:boolean,has_next:boolean,end_cursor:string,filter_keys:array<string>,sample_keys:array<string>,head:string>"
OPTION = "struct<dimension:string,query_key:string,value:string,texts:array<string>>"


def plain(key: str) -> str:
    return "".join(c for c in key.lower() if c.isascii() and c.isalnum())


def _loaded(body: str | None):
    """(valid, value)"""
    try:
        return (False, None) if body is None else (True, json.loads(body))
    except (ValueError, RecursionError):
        return False, None


def _nodes(value) -> Iterator:
    """A value and all values in it, outer ones and earlier ones first."""
    stack = [value]
    while stack:
        one = stack.pop()
        yield one
        inner = one.values() if isinstance(one, dict) else one if isinstance(one, list) else ()
        stack.extend(reversed(list(inner)))


def _dumped(value, **options) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, **options)


def _kind(value) -> str:
    return "list" if isinstance(value, list) else "dict" if isinstance(value, dict) else "scalar"


def _arrow(f: Callable, kind: str):
    return F.udf(f, kind, useArrow=True)


def objects(body: Column, keys: tuple[str, ...]) -> Column:
    """array<OBJECT>: every JSON object with one of the keys. Maps go by normalised key and lack empty values; ``listed``
    and ``compact`` are the object with sorted keys, ``scalars`` its plain values with blanks between them."""
    wanted = {plain(k) for k in keys}

    def found(text):
        valid, value = _loaded(text)
        out = []
        for node in _nodes(value) if valid else ():
            if isinstance(node, dict) and wanted & {plain(k) for k in node}:
                own = {k: v for k, v in {plain(k): v for k, v in node.items()}.items() if v is not None and v != "" and v != []}
                out.append(
                    {
                        "nth": len(out),
                        "kinds": {k: _kind(v) for k, v in own.items()},
                        "texts": {k: _dumped(v) if isinstance(v, (dict, list)) else str(v) for k, v in own.items()},
                        "items": {k: [str(x) for x in v if not isinstance(x, (dict, list)) and x is not None] for k, v in own.items() if isinstance(v, list)},
                        "listed": _dumped(node),
                        "compact": _dumped(node, separators=(",", ":")),
                        "scalars": " ".join(str(v) for v in node.values() if isinstance(v, (str, int, float))),
                    }
                )
        return out

    return _arrow(found, f"array<{OBJECT}>")(body)


def _total(value):
    """The first whole number under a key of totals, an object's own before those of its parts."""
    for node in _nodes(value):
        for k, v in node.items() if isinstance(node, dict) else ():
            if plain(k) in R.API_TOTAL_KEYS and isinstance(v, int):
                return int(v)
    return None


def _page_info(value) -> dict:
    for node in _nodes(value):
        for k in ("pageInfo", "page_info") if isinstance(node, dict) else ():
            if isinstance(node.get(k), dict):
                return node[k]
    return {}


def _filter_keys(value) -> list[str]:
    found: set[str] = set()
    stack = [(value, False)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                held = plain(k) in R.API_FILTER_CONTAINERS
                if inside and not held and plain(k) in R.API_FILTER_METADATA_KEYS and isinstance(v, (list, dict)):
                    found.add(k)
                stack.append((v, inside or held))
        elif isinstance(node, list):
            stack.extend((v, inside) for v in node)
    return sorted(found, key=str.casefold)


def _sample_keys(value, most: int = 20) -> list[str]:
    """The first distinct keys; of an object each key comes before those in its value."""
    seen: dict[str, None] = {}
    stack: list = [(None, value)]
    while stack and len(seen) < most:
        key, node = stack.pop()
        if key is not None:
            seen.setdefault(key)
        inner = node.items() if isinstance(node, dict) else ((None, v) for v in node) if isinstance(node, list) else ()
        stack.extend(reversed(list(inner)))
    return list(seen)


def facts(body: Column) -> Column:
    """FACTS of a body: total count, whole numbers of the outermost object, paging, filter and sample keys, its head."""

    def found(text):
        valid, value = _loaded(text)
        if not valid:
            return {"valid": False, "total": None, "top": [], "paged": False, "has_next": None, "end_cursor": None, "filter_keys": [], "sample_keys": [], "head": ""}
        info = _page_info(value)
        has_next, cursor = info.get("hasNextPage"), info.get("endCursor") or info.get("end_cursor")
        return {
            "valid": True,
            "total": _total(value),
            "top": [{"k": plain(k), "v": int(v)} for k, v in value.items() if isinstance(v, int)] if isinstance(value, dict) else [],
            "paged": bool(info),
            "has_next": has_next if isinstance(has_next, bool) else None,
            "end_cursor": cursor if isinstance(cursor, str) and cursor else None,
            "filter_keys": _filter_keys(value),
            "sample_keys": _sample_keys(value),
            "head": json.dumps(value, ensure_ascii=False)[:12000],
        }

    return _arrow(found, FACTS)(body)


def pretty(body: Column) -> Column:
    """JSON with sorted keys, two blanks a level; anything else as it is."""

    def shown(text):
        valid, value = _loaded(text)
        return _dumped(value, indent=2) if valid else text

    return _arrow(shown, "string")(body)


def json_links(body: Column, base: Column) -> Column:
    """Distinct texts of a JSON body that are links, joined to its address, in their order."""

    def found(text, base):
        valid, value = _loaded(text)
        return [urljoin(base, v) for v in _nodes(value) if isinstance(v, str)] if valid and base else []

    def texts(text):
        valid, value = _loaded(text)
        return [v for v in _nodes(value) if isinstance(v, str)] if valid else []

    all_ = F.arrays_zip(_arrow(texts, "array<string>")(body).alias("t"), _arrow(found, "array<string>")(body, base).alias("u"))
    link = lambda t: F.trim(t).rlike("^(?:https?://|/)") | F.trim(t).rlike(r"(?i)\.(?:html?|pdf|json)(?:[?#].*)?$")
    return F.array_distinct(F.transform(F.filter(all_, lambda z: link(z["t"])), lambda z: z["u"]))


# Claims and programme rows --------------------------------------------------------------------------------------------


def _value(o: Column, keys: tuple[str, ...]) -> Column:
    """The text of the first key that has a value; null if that is a list or an object."""
    names = F.array(*(F.lit(plain(k)) for k in keys))
    first = F.get(F.filter(names, lambda k: F.map_contains_key(o["texts"], k)), 0)
    return bound(first, lambda k: F.when(o["kinds"][k] == "scalar", o["texts"][k]))


def _text(o: Column, keys: tuple[str, ...]) -> Column:
    return nullif_empty(clean(_value(o, keys)))


def claims(sources: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Claims of JSON sources (body, source_url): key, field, claim_path (numbered by field and ``order`` within the key),
    value, snippet, source_url."""
    keys = tuple(k for own in R.API_CLAIM_KEYS.values() for k in own)
    found = sources.select(*key, *order, "source_url", F.explode(objects(F.col("body"), keys)).alias("o"))
    o = F.col("o")

    def listed(field: str) -> Column:
        names = F.array(*(F.lit(plain(k)) for k in R.API_CLAIM_KEYS[field]))
        first = F.get(F.filter(names, lambda k: F.map_contains_key(o["texts"], k)), 0)
        return bound(first, lambda k: F.when(o["kinds"][k] == "list", F.array_join(o["items"][k], ", ")).otherwise(o["texts"][k]))

    programme = _value(o, R.API_CLAIM_KEYS["programmes"])
    values = {"programmes": F.when(programme.rlike(R.API_PROGRAMME_PATTERN), programme)} | {f: listed(f) for f in list(R.API_CLAIM_KEYS)[1:]}
    rows = found.select(*key, *order, "source_url", "o.nth", F.substring("o.listed", 1, 500).alias("snippet"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()))).alias("c"))
    rows = rows.where(F.col("c.value").isNotNull()).select("*", "c.field", "c.value")
    nth = (F.row_number().over(Window.partitionBy(*key, "field").orderBy(*order, "nth")) - 1).cast("string")
    path = F.when(F.col("field") == "programmes", F.concat(F.lit("/programmes/"), nth, F.lit("/name"))).when(F.col("field") == "fees", F.concat(F.lit("/fees/"), nth, F.lit("/value"))).otherwise(F.concat(F.lit("/admissions/"), F.col("field"), F.lit("/"), nth, F.lit("/value")))
    return rows.select(*key, "field", path.alias("claim_path"), "value", "snippet", "source_url")


def _catalog_name(o: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(o, R.API_NAME_KEYS), R.API_NAME_TAIL_PATTERN, ""), r"[.;:,]+$", "")


def catalog_object(o: Column) -> Column:
    """struct<name, award, faculty, category, mode, duration, choice, specialisations> of a JSON object that is a
    programme, else null."""

    def judged(name: Column) -> Column:
        lower, context = F.lower(name), F.lower(o["listed"])
        named = F.length(name).between(3, 160) & ~lower.isin(*R.API_NOT_NAMES) & ~contains_any(lower, R.API_NOT_NAME_TERMS) & (F.regexp_count(name, F.lit("[.;:]")) <= 3)
        signal = F.concat_ws(" ", lower, context).rlike(R.API_SIGNAL_PATTERN)
        navigation = lower.isin(*R.API_NAVIGATION_NAMES) | contains_any(context, R.API_NAVIGATION_TERMS)
        award = F.coalesce(_text(o, R.API_DEGREE_KEYS), F.when(name.rlike(R.API_AWARD_PATTERN), name))
        keys = F.array(*(F.lit(plain(k)) for k in R.API_SPECIALISATION_KEYS))
        first = F.get(F.filter(keys, lambda k: F.map_contains_key(o["texts"], k)), 0)
        special = bound(first, lambda k: F.coalesce(o["items"][k], F.array().cast("array<string>")))
        special = F.filter(F.transform(special, lambda s: F.regexp_replace(F.regexp_replace(clean(s), R.API_NAME_TAIL_PATTERN, ""), r"[.;:,]+$", "")), lambda s: F.length(s) > 2)

        def row(hay: Column) -> Column:
            category = (
                F.when(hay.contains("minor"), "minor")
                .when(hay.contains("major") & ~hay.contains("bachelor"), "major")
                .when(hay.contains("double degree") | hay.contains("dual degree"), "dual_degree")
                .when(hay.contains("special programme"), "special_programme")
                .when(hay.rlike(R.API_DEGREE_PATTERN), "degree_programme")
                .when(hay.contains("program"), "special_programme")
                .otherwise("unknown")
            )
            return F.struct(name.alias("name"), award.alias("award"), _text(o, R.API_FACULTY_KEYS).alias("faculty"), category.alias("category"), mode_of(F.coalesce(_value(o, R.API_MODE_KEYS), o["listed"])).alias("mode"), _text(o, R.API_DURATION_KEYS).alias("duration"), _text(o, R.API_CHOICE_KEYS).alias("choice"), special.alias("specialisations"))

        hay = F.lower(F.concat_ws(" ", name, F.coalesce(award, F.lit("")), o["scalars"]))
        return F.when(named & signal & ~navigation, bound(hay, row))

    return bound(_catalog_name(o), judged)


def catalog_rows(sources: DataFrame, key: list[str], order: list[str], start: int = 0) -> DataFrame:
    """Programme rows of JSON sources (body, source_url), numbered by ``order`` within the key; repeated names and awards
    of one source are left out."""
    rows = sources.select(*key, *order, "source_url", F.explode(objects(F.col("body"), R.API_NAME_KEYS)).alias("o")).withColumn("r", catalog_object(F.col("o"))).where("r is not null")
    same = Window.partitionBy(*key, *order, F.lower("source_url"), F.lower("r.name"), F.lower("r.award")).orderBy("o.nth")
    rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order, "o.nth")) - 1 + start
    parsed = F.col("r.award").isNotNull() & (F.col("r.category") != "unknown")
    labels = {"ambiguous_degree": F.col("r.award").isNull(), "missing_faculty": F.col("r.faculty").isNull(), REVIEW: ~parsed}
    return rows.select(
        *key,
        F.concat(F.lit("/programme_catalog/"), nth.cast("string"), F.lit("/name")).alias("claim_path"),
        F.col("r.name").alias("name"),
        F.col("r.faculty").alias("faculty_or_school"),
        F.col("r.award").alias("degree_or_award"),
        F.col("r.category").alias("category"),
        F.col("r.mode").alias("mode"),
        F.col("r.duration").alias("duration_or_units"),
        F.col("r.choice").alias("admissions_choice_name"),
        F.col("r.specialisations").alias("specialisations_or_majors"),
        "source_url",
        F.substring("o.compact", 1, 700).alias("evidence_snippet"),
        F.when(parsed, "high").otherwise("medium").alias("evidence_confidence"),
        F.when(parsed, "parsed").otherwise(REVIEW).alias("parse_status"),
        F.filter(F.array(*(F.when(t, F.lit(w)) for w, t in labels.items())), lambda w: w.isNotNull()).alias("warnings"),
    )


def profiles(bodies: DataFrame, accepted: Column | None = None) -> DataFrame:
    """``bodies`` (.., body) with the counts and signals of each: whether it is a catalogue and why not, and with
    ``accepted`` rows how many were refused and whether paging is complete."""
    o = bodies.withColumns({"_f": facts(F.col("body")), "_o": objects(F.col("body"), R.API_NAME_KEYS)})
    rows = F.size(F.filter(F.transform("_o", catalog_object), lambda r: r.isNotNull()))
    valid, total = F.col("_f.valid"), F.col("_f.total")
    words = valid & F.lower("_f.head").rlike(R.API_VOCABULARY_PATTERN)
    filters = F.size("_f.filter_keys") > 0
    out = o.withColumns({"candidate_objects": F.size("_o"), "parseable_rows": rows, "total": total, "filter_keys": F.col("_f.filter_keys"), "sample_keys": F.col("_f.sample_keys")})
    some, parsed = F.col("candidate_objects") > 0, F.col("parseable_rows") > 0
    likely = parsed | (filters & words) | (some & total.isNotNull() & words)
    signals = {"programme_like_object_keys": some, "parseable_programme_rows": parsed, "pagination_total_count": total.isNotNull(), "catalog_filter_metadata": filters, "catalog_vocabulary": words}
    out = out.withColumns({"likely_catalog": likely, "signals": F.filter(F.array(*(F.when(t, F.lit(s)) for s, t in signals.items())), lambda s: s.isNotNull()), "rejection_reason": F.when(~valid, "invalid_json").when(~likely, "body_not_catalog_like")})
    if accepted is not None:
        known = total.isNotNull()
        out = out.withColumns({"rejected_rows": F.greatest(F.lit(0), F.col("candidate_objects") - accepted), "complete": known & (accepted >= total), "incomplete": known & (accepted < total)})
    return out.drop("_f", "_o")


def high_cardinality(rows: Column, pages: Column, mode: Column, total: Column) -> Column:
    """Whether an answer is a large catalogue, so that its programmes aren't claims of their own."""
    return (rows > 1) | (pages > 1) | mode.isNotNull() | F.coalesce(total > 1, F.lit(False))


def is_dynamic_shell(text: Column) -> Column:
    """A catalogue page with filters and without rows."""

    def of(lower: Column) -> Column:
        terms = F.size(F.filter(F.array(*map(F.lit, R.DYNAMIC_FILTER_TERMS)), lambda t: lower.contains(t)))
        filters = (lower.contains("programme level") & lower.contains("programme type")) | (terms >= 4)
        return (lower != "") & filters & contains_any(lower, R.DYNAMIC_LEVEL_TERMS)

    rows = [text.rlike(p) for p in R.DYNAMIC_ROW_PATTERNS]
    return bound(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), of) & ~(rows[0] | rows[1])


# Paging ---------------------------------------------------------------------------------------------------------------


def unsafe_url_reason(first: Column, following: Column) -> Column:
    """Why a next or filtered address isn't fetched, else null."""
    return F.when(~F.lower(U.part(following, 1)).isin("http", "https"), "rejected_non_http").when(U.part(following, 2) != U.part(first, 2), "rejected_off_domain").when(U.has_sensitive_query(first) | U.has_sensitive_query(following), "rejected_auth_or_token")


def _top(f: Column, *keys: str) -> Column:
    return F.get(F.filter(f["top"], lambda p: p["k"].isin(*(plain(k) for k in keys))), 0)["v"]


def next_page(f: Column, url: Column) -> Column:
    """struct<url, mode, complete, reason> of the page after one with these facts: by cursor, offset or page number."""
    none = F.lit(None).cast("string")
    plan = lambda to, mode, complete, reason: F.struct(to.alias("url"), F.lit(mode).alias("mode"), F.lit(complete).alias("complete"), F.lit(reason).alias("reason"))
    after = F.coalesce(U.query_key(url, "after", "cursor"), F.lit("after"))
    cursor = F.when(f["has_next"] == False, plan(none, "cursor", True, "pagination_complete")).when(f["has_next"] & f["end_cursor"].isNotNull(), plan(U.with_query_value(url, after, f["end_cursor"]), "cursor", False, "next_cursor")).otherwise(plan(none, "cursor", False, "cursor_without_end_cursor"))  # noqa: E712

    offset_key, limit_key, page_key = U.query_key(url, "offset", "skip"), U.query_key(url, "limit", "take"), U.query_key(url, "page", "pagenumber")
    at = F.when(offset_key.isNotNull(), U.first_int(url, offset_key)).otherwise(_top(f, "offset", "skip"))
    limit = F.when(limit_key.isNotNull(), U.first_int(url, limit_key)).otherwise(_top(f, "limit", "take", "pageSize"))
    offset = F.when(f["total"].isNotNull() & (at + limit >= f["total"]), plan(none, "offset", True, "pagination_complete")).otherwise(plan(U.with_query_value(url, F.coalesce(offset_key, F.lit("offset")), at + limit), "offset", False, "next_offset"))

    page = F.when(page_key.isNotNull(), U.first_int(url, page_key)).otherwise(_top(f, "page", "currentPage", "pageNumber"))
    sizes = ("pagesize", "limit", "perpage", "size")
    stated = U.first_int(url, U.query_key(url, *sizes))
    size = F.coalesce(F.when(stated != 0, stated), _top(f, *sizes))
    last = _top(f, "totalPages", "pageCount")
    done = F.coalesce(page >= last, F.lit(False)) | F.coalesce((size > 0) & (page * size >= f["total"]), F.lit(False))
    by_page = F.when(done, plan(none, "page", True, "pagination_complete")).otherwise(plan(U.with_query_value(url, F.coalesce(page_key, F.lit("page")), page + 1), "page", False, "next_page"))
    nothing = F.struct(none.alias("url"), none.alias("mode"), F.lit(False).alias("complete"), F.when(f["valid"], "pagination_not_detected").otherwise("invalid_json").alias("reason"))
    return F.when(f["paged"], cursor).when(at.isNotNull() & (limit > 0), offset).when(page.isNotNull(), by_page).otherwise(nothing)


def pages_followed(first: DataFrame, captured: DataFrame, most: int = 5) -> DataFrame:
    """The pages of endpoints: first (endpoint, url), captured (url, ok, is_json, body, content_hash; one row a url).
    Returns endpoint, mode, page_count, fetched, rejected array<struct<url, reason>>, completed, budget_hit, stop_reason.

    Each captured page's next address is worked out once; then at most ``most`` - 1 joins follow them. A page with a
    known address or body, an unsafe address, or one that isn't captured or isn't JSON ends its endpoint.

    Captured pages are as many as endpoints and more, whatever size the planner takes them for: they are sorted and
    merged, never sent to the driver. Endpoints that have ended go by keys of their own, not all to the null key's task."""
    known = captured.withColumn("_facts", facts(F.col("body"))).withColumn("_plan", next_page(F.col("_facts"), F.col("url"))).select("url", "ok", "is_json", "content_hash", F.col("_plan").alias("plan"))
    now = first.select("endpoint", F.col("url").alias("start")).join(known.withColumnRenamed("url", "start").hint("merge"), "start", "left")
    texts = F.array().cast("array<string>")
    state = now.select(
        "endpoint",
        "start",
        "plan",
        F.col("plan.mode").alias("mode"),
        F.lit(1).alias("page_count"),
        F.array("start").alias("urls"),
        F.filter(F.array("content_hash"), lambda h: h.isNotNull()).alias("hashes"),
        texts.alias("fetched"),
        F.array().cast("array<struct<url:string,reason:string>>").alias("rejected"),
        F.lit(False).alias("completed"),
        F.lit(None).cast("string").alias("stop_reason"),
    )
    for _ in range(most - 1):
        following = known.select(F.col("url").alias("n_url"), F.col("ok").alias("n_ok"), F.col("is_json").alias("n_json"), F.col("content_hash").alias("n_hash"), F.col("plan").alias("n_plan"))
        open_ = F.col("stop_reason").isNull()
        to = F.when(open_ & ~F.col("plan.complete"), F.col("plan.url"))
        own = F.concat(F.lit(" "), F.col("endpoint").cast("string"))  # what it might meet doesn't count, since there is no next address
        s = state.withColumn("to", to).withColumn("at", F.coalesce("to", own)).join(following.hint("merge"), F.col("at") == F.col("n_url"), "left")
        refused = F.coalesce(
            unsafe_url_reason(F.col("start"), F.col("to")),
            F.when(F.array_contains("urls", F.col("to")), "duplicate_page_url"),
            F.when(~F.coalesce("n_ok", F.lit(False)), "fetch_failed"),
            F.when(~F.col("n_json"), "non_json_response"),
            F.when(F.array_contains("hashes", F.col("n_hash")), "duplicate_page_body"),
        )
        s = s.withColumn("bad", F.when(F.col("to").isNotNull(), refused))
        stop = F.when(~open_, F.col("stop_reason")).when(F.col("plan").isNull(), "fetch_failed").when(F.col("to").isNull(), F.col("plan.reason")).otherwise(F.col("bad"))
        go = open_ & F.col("to").isNotNull() & F.col("bad").isNull()
        state = s.select(
            "endpoint",
            "start",
            F.when(go, F.col("n_plan")).otherwise(F.col("plan")).alias("plan"),
            F.coalesce("mode", F.when(go, F.col("n_plan.mode"))).alias("mode"),
            F.when(go, F.col("page_count") + 1).otherwise(F.col("page_count")).alias("page_count"),
            F.when(go, F.array_append("urls", F.col("to"))).otherwise(F.col("urls")).alias("urls"),
            F.when(go & F.col("n_hash").isNotNull(), F.array_append("hashes", F.col("n_hash"))).otherwise(F.col("hashes")).alias("hashes"),
            F.when(go, F.array_append("fetched", F.col("to"))).otherwise(F.col("fetched")).alias("fetched"),
            F.when(open_ & F.col("bad").isNotNull(), F.array_append("rejected", F.struct(F.col("to").alias("url"), F.col("bad").alias("reason")))).otherwise(F.col("rejected")).alias("rejected"),
            (F.col("completed") | (open_ & F.coalesce("plan.complete", F.lit(False)))).alias("completed"),
            stop.alias("stop_reason"),
        )
    return state.select("endpoint", "mode", "page_count", "fetched", "rejected", "completed", F.col("stop_reason").isNull().alias("budget_hit"), F.coalesce("stop_reason", F.lit("pagination_budget_hit")).alias("stop_reason"))


# Filters --------------------------------------------------------------------------------------------------------------

_DIMENSION = {key: name for name, keys in R.FILTER_DIMENSIONS.items() for key in keys}


def _alnum(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def _scalar(item: dict, *keys: str) -> str | None:
    own = {_alnum(k): v for k, v in item.items()}
    given = (own.get(_alnum(k)) for k in keys)
    return next((str(v).strip() for v in given if isinstance(v, (str, int, float)) and str(v).strip()), None)


def _option(raw, query_key: str, dimension: str) -> dict | None:
    if isinstance(raw, dict):
        value = _scalar(raw, "value", "id", "code", "slug", "key", "name", "label", "title")
        texts = [value, *(_scalar(raw, k) for k in ("label", "name", "title", "displayName", "text"))]
    else:
        value = str(raw).strip() if isinstance(raw, (str, int, float)) else None
        texts = [value]
    return {"dimension": dimension, "query_key": query_key, "value": value, "texts": [t for t in dict.fromkeys(texts) if t]} if value else None


def _described(node: dict) -> list[dict]:
    """Options that an object lists for the dimension that it names."""
    listed = next((node[k] for k in ("options", "values", "items", "choices", "facets") if isinstance(node.get(k), list) and node[k]), None)
    names = [_scalar(node, k) for k in ("param", "parameter", "field", "key", "name", "id")]
    dimension = next((d for d in (_DIMENSION.get(_alnum(n or "")) for n in names) if d), None)
    keys = [_scalar(node, k) for k in ("param", "parameter", "field", "key", "id")]
    query = next((k for k in keys if k and _alnum(k) in _DIMENSION), None) or R.FILTER_QUERY_KEYS.get(_DIMENSION.get(_alnum(_scalar(node, "name") or ""), ""))
    return [_option(raw, query, dimension) for raw in listed] if listed and dimension and query else []


def filter_options(body: Column) -> Column:
    """array<OPTION>: distinct values that a body's filters offer, by dimension, in their order."""

    def found(text):
        valid, value = _loaded(text)
        out: dict = {}

        def add(options) -> None:
            for o in options:
                if o:
                    out.setdefault((o["dimension"], o["value"]), o)

        def visit(node, inside: bool) -> None:
            if isinstance(node, list):
                for v in node:
                    visit(v, inside)
            elif isinstance(node, dict):
                if inside:
                    add(_described(node))
                for k, v in node.items():
                    if inside and _alnum(k) in _DIMENSION:
                        add(_option(raw, k, _DIMENSION[_alnum(k)]) for raw in (v if isinstance(v, list) else [v]))
                    visit(v, inside or _alnum(k) in R.FILTER_CONTAINERS)

        if valid:
            visit(value, False)
        return list(out.values())

    return _arrow(found, f"array<{OPTION}>")(body)


def filter_plan(options: Column, url: Column, most: int = 5) -> Column:
    """struct<urls, budget_hit>: addresses of the endpoint with the undergraduate, degree and full-time options, then of
    these with each faculty or school (five a query key); distinct, at most ``most``."""
    pairs = []
    for dimension, targets in R.FILTER_TARGETS.items():
        texts = lambda o: F.exists(o["texts"], lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "").isin(*targets))  # noqa: B023, E731
        one = F.get(F.filter(options, lambda o: (o["dimension"] == dimension) & texts(o)), 0)  # noqa: B023
        named = F.coalesce(U.same_query_key(url, one["query_key"]), F.when(F.regexp_replace(F.lower(one["query_key"]), r"[^\p{L}\p{N}]", "").isin(*R.FILTER_DIMENSIONS[dimension]), one["query_key"]), F.lit(R.FILTER_QUERY_KEYS[dimension]))
        pairs.append(F.when(one.isNotNull(), F.struct(named.alias("k"), one["value"].alias("v"))))
    core = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    schools = F.filter(options, lambda o: o["dimension"] == "faculty_or_school")
    schools = F.filter(schools, lambda o, i: F.size(F.filter(F.slice(schools, 1, i), lambda e: e["query_key"] == o["query_key"])) < 5)

    def planned(c: Column) -> Column:
        each = F.transform(schools, lambda o: F.concat(c, F.array(F.struct(o["query_key"].alias("k"), o["value"].alias("v")))))
        plans = F.concat(F.when(F.size(c) > 0, F.array(c)).otherwise(F.slice(F.array(c), 1, 0)), each)
        urls = F.array_distinct(F.transform(plans, lambda p: U.canonical_url(U.with_query_pairs(url, p))))
        return bound(F.filter(urls, lambda u: u != U.canonical_url(url)), lambda u: F.struct(F.slice(u, 1, most).alias("urls"), (F.size(u) > most).alias("budget_hit")))

    return bound(core, planned)
