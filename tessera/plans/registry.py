"""Every query of the library by name, with the SQL that states its expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import captures, catalogue, claims, pages, scans, streams
from tessera.plans.base import QUERIES, SQL, Query

__all__ = ["captures", "catalogue", "claims", "entry", "oracle_sql", "pages", "queries", "scans", "streams"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pages_by_domain"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
