"""A training-data pipeline of five of the operators; each stage's result is written as Parquet and read again.

Stages decide on rows: of rows that share an id, each is judged by its own text. Defined cases: rows with a null id pass
all stages and take nothing from others; null and empty texts pass, and are packed as an empty document's one token; of
rows that repeat both id and text one stays after near_dedup; empty tables give no rows; other columns are kept, whatever
their names, but for names that begin with an underscore.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import shared_dir, table
from tessera.llm.decontamination import decontaminated
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_sequences
from tessera.llm.queries import TOXIC_AT, tokenizer_path, toxicity_scores
from tessera.llm.substring_dedup import substring_dedup, text_hash


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).where(F.col("p_toxic") < TOXIC_AT).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    found = near_duplicates(docs, with_hash=True).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n"))
    found = found.where("not _kept or _n > 1")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.col("text")) == F.col("_hash"))
    kept = docs.join(found.where("not _kept"), same, "left_anti")
    repeated = found.where("_kept").select("_id", "_hash")
    if not repeated.isEmpty():
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that a document with a smaller id holds; untouched texts stay as they are."""
    cut = substring_dedup(docs, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("kept").alias("_text")).dropDuplicates(["_id", "_hash"])
    joined = docs.join(cut, (F.col("doc_id") == F.col("_id")) & (text_hash(F.col("text")) == F.col("_hash")), "left")
    new = {"text": F.coalesce("_text", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_text").cast("long"), F.col("n_chars"))
    return joined.withColumns(new).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in training sequences."""
    return pack_sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No SQL expresses the tokeniser, the classifier or the packing. Tests hold each stage on its own input against a plain
#: version, and run() against the chain of stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, out, sf_dir).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
    return out
