"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

DataFrame functions only. Records are spread by ranges of (URL, time), so that one URL with a third of all records is
spread by time; within each range a window finds the latest full response, and what a range begins with comes from one
summary row for each URL and range. The earlier response is resolved if the revisit's validators agree with it: an
entity tag (compared weakly) if the revisit has one, else its last-modified date. Permitted headers of the revisit
replace those of the stored response.

Defined cases: a record with a null URL or time joins with nothing (status no_earlier_response); a full response at the
same time is not earlier; among full responses of the same URL and time the greatest record id counts; a revisit
without validators is no_validator; header names are compared in lower case, a repeated name keeps its last value; null
headers are empty; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import written

#: Headers of a 304 response that update a stored one (RFC 9110 section 15.4.5, RFC 9111 section 3.2). Fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """What tells captures apart: not http or https, user information, ``www.``, the default port, the fragment, tracking
    parameters (``utm_*`` and ``ref``) or last slashes. Addresses without an authority (``dns:a.com``, ``urn:x:1``,
    ``a.com/x``) keep all but the fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    given = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)"))
    query = F.array_join(given, "&")
    lead = F.when(scheme.isin("", "http", "https"), "").otherwise(F.concat(scheme, F.lit("://")))
    named = F.concat(lead, place, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    bare = F.regexp_replace(F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?", 1)), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")), r"#.*$", "")
    return F.when(url.isNotNull(), F.when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), named).otherwise(bare))


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of a repeated name the last value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolved_revisits(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "captured", kind_col: str = "kind", headers_col: str = "headers") -> DataFrame:
    """Per revisit record (kind ``revisit``; full responses have kind ``response``): id, url key, captured, status
    (resolved, no_earlier_response, no_validator, validator_mismatch), response_id, headers (merged if resolved)."""
    base = records.select(F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("key"), F.col(time_col).alias("at"), F.col(kind_col).alias("kind"), _lower_keys(F.col(headers_col)).alias("headers")).where("kind in ('response', 'revisit')")
    # At one time the revisits come first: a response of that time isn't earlier.
    rank = F.when(F.col("kind") == "revisit", 0).otherwise(1)
    joinable = F.col("key").isNotNull() & F.col("at").isNotNull()
    spread = written(base.where(joinable).withColumn("rank", rank).repartitionByRange("key", "at", "rank", "id").withColumn("part", F.spark_partition_id()), "records")
    full = F.when(F.col("kind") == "response", F.struct(F.col("id"), F.col("headers")))
    here = Window.partitionBy("part", "key").orderBy("at", "rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("earlier", F.last(full, ignorenulls=True).over(here))
    ends = spread.where("kind = 'response'").groupBy("key", "part").agg(F.max_by(F.struct("id", "headers"), F.struct("at", "id")).alias("last"))
    begins = spread.select("key", "part").distinct().join(ends, ["key", "part"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a URL
    carried = begins.select("key", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = local.where("kind = 'revisit'").join(carried, ["key", "part"], "left").select("id", "key", "at", "headers", F.coalesce("earlier", "carried").alias("stored"))
    rest = base.where(~joinable & (F.col("kind") == "revisit")).select("id", "key", "at", "headers")
    joined = joined.unionByName(rest.withColumn("stored", F.lit(None).cast(joined.schema["stored"].dataType)))
    tag = lambda headers: F.regexp_replace(F.element_at(headers, "etag"), r"^[Ww]/", "")
    stored = F.col("stored.headers")
    own_tag, own_date = tag(F.col("headers")), F.element_at("headers", "last-modified")
    same = F.when(own_tag.isNotNull(), own_tag.eqNullSafe(tag(stored))).otherwise(own_date.eqNullSafe(F.element_at(stored, "last-modified")))
    status = F.when(F.col("stored").isNull(), "no_earlier_response").when(own_tag.isNull() & own_date.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    permitted = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    out = joined.withColumn("status", status)
    return out.select(F.col("id").alias(id_col), F.col("key").alias("url_key"), F.col("at").alias(time_col), "status", F.when(F.col("status") == "resolved", F.col("stored.id")).alias("response_id"), F.when(F.col("status") == "resolved", merged).alias("headers"))
