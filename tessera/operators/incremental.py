"""Differences between results, merges of several seeds, and limits of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed(current: DataFrame, previous: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """Keys (of one column or several, one row a key) of both whose value differs (null-safe); new and removed keys are
    left out, as are null previous values."""
    key = [key] if isinstance(key, str) else key
    old = previous.select(*key, F.col(value).alias("_old")).where(F.col("_old").isNotNull())
    return current.join(old, key).where(~F.col(value).eqNullSafe(F.col("_old"))).select(*key)


def merged_claims(claims: DataFrame) -> DataFrame:
    """Claims of several seeds under one result: indexes run on from seed to seed within a field."""
    w = Window.partitionBy("university", "field").orderBy("seed_order", "index")
    new = F.row_number().over(w) - 1
    return claims.withColumn("new_index", new).withColumn("claim_path", F.format_string("/%s/%d/value", F.col("field"), new))


_PLACE = r"^(.*?)/([0-9]+)(/.*)?$"


def merged_results(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence (university, seed_order, claim_path, ..) of several seeds under one result: places in a list
    run on from seed to seed, and evidence follows its claim. Of later seeds only evidence that a claim has is kept, and
    a place that isn't in a list stays as it is."""
    place = lambda n: F.regexp_extract("claim_path", _PLACE, n)
    lists = claims.where(place(2) != "").groupBy("university", "seed_order", place(1).alias("_list")).agg((F.max(place(2).cast("int")) + 1).alias("_n"))
    before = Window.partitionBy("university", "_list").orderBy("seed_order").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lists.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")

    def moved(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("_list", place(1)).join(offsets, ["university", "seed_order", "_list"], "left")
        path = F.concat(F.col("_list"), F.lit("/"), (place(2).cast("int") + F.col("_offset")).cast("string"), place(3))
        return at.withColumn("claim_path", F.when(F.col("_offset").isNotNull(), path).otherwise(F.col("claim_path"))).drop("_list", "_offset")

    first = claims.groupBy("university").agg(F.min("seed_order").alias("_first"))
    own = claims.select("university", "seed_order", "claim_path", F.lit(True).alias("_own")).distinct()
    kept = evidence.join(first, "university").join(own, ["university", "seed_order", "claim_path"], "left").where((F.col("seed_order") == F.col("_first")) | F.col("_own")).drop("_first", "_own")
    return moved(claims), moved(kept)


def limit(configured: Column, given: Column, cap: Column) -> Column:
    """A configured limit, else the lesser of the given one and the cap."""
    return F.coalesce(configured, F.least(given, cap))
