"""Sinks: result tables, one JSON document a scan, the catalogue CSV and a content-addressed source store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sources(sources: DataFrame, path: str) -> None:
    """Source texts, one row for each content hash, spread by the hash's first two digits."""
    first = sources.groupBy("content_hash").agg(F.min_by(F.struct(*(c for c in sources.columns if c != "content_hash")), "source_url").alias("s"))
    first.select("content_hash", "s.*", F.substring("content_hash", 1, 2).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_result_json(rows: DataFrame, path: str) -> None:
    """Each row as a JSON document, nulls included."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_catalogue_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
