"""The batch functions on a stream of captured pages, and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U


def new_pages(feed: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Pages of a stream (url, html, captured timestamp) once for each canonical URL and content within the watermark."""
    keyed = feed.withColumn("canonical_url", U.canonical_url(F.col("url"))).withColumn("content_hash", T.content_hash(F.col("html")))
    return keyed.withWatermark("captured", lateness).dropDuplicatesWithinWatermark(["canonical_url", "content_hash"])


def host_counts(feed: DataFrame, lateness: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Pages by host and tumbling window."""
    rows = feed.withColumn("host", U.host(F.col("url"))).withWatermark("captured", lateness)
    return rows.groupBy(F.window("captured", every), "host").agg(F.count("*").alias("pages"))


def event_windows(events: DataFrame, lateness: str = "1 day", every: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; works on a batch and on a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
