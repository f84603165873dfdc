"""The streaming extension's queries, run over the batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.base import query, table
from tessera.streaming import feed


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return feed.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
