"""License scans by canonical digests; DataFrame functions only.

A text is put into canonical form - lower case, equivalent spellings made one, lines dropped that state a copyright
holder or year, everything but letters and digits made single blanks - and the SHA-256 digest of that form is looked up among those of known licence
texts. The same is done with every line of a text against known one-line notices.

Defined cases: null, empty and mark-only texts have the digest of the empty text and match nothing; repeated rows are
returned each; with a null id too; a digest that several licences share gives the first name; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.licence_texts import NOTICES, SPELLINGS, TEXTS

#: Words that follow "copyright" in the prose of licences, where no holder or year is stated.
PROSE = "notices? holders? owners? owned laws? licen[cs]es? licensed interests? statements? protection treaty act rights? disclaimers? disclaimed ownership permission patents? works? status or and in is to the that for on of as a with any".split()
_COPYRIGHT = rf"(?m)^[ \t#*/;-]*(?:copyright(?![ \t]+(?:{'|'.join(PROSE)})\b)(?=[ \t:]*[^\s:])|\(c\)[ \t]*(?:copyright\b|[0-9]{{4}})|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The form whose digest is compared."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, one in SPELLINGS * 2:  # twice, for neighbours that share a blank
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


def known_licences(spark, texts: dict[str, str]) -> DataFrame:
    """(name, digest) of the canonical forms; a handful of rows."""
    rows = spark.createDataFrame(sorted(texts.items()), "name string, text string")
    return rows.select("name", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("name").alias("name"))


def _begins(spark, notices: dict[str, str]) -> str:
    """A pattern of the lower-case lines whose canonical form can be a notice's: they begin with its first word, or with
    another spelling of it."""
    rows = spark.createDataFrame([(text,) for text in notices.values()], "text string").select(canonical(F.col("text")).alias("c"))
    first = {r.c.split(" ")[0] for r in rows.collect() if r.c}
    for other, one in reversed(SPELLINGS * 2):
        if one.split(" ")[0] in first:
            first.add(other.split(" ")[0])
    return r"^[^\p{L}\p{N}]*(?:" + "|".join(sorted(first)) + r")(?![\p{L}\p{N}])" if first else "(?!)"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row: id, digest, license (of the whole text, else null), notices (names of one-line notices, sorted)."""
    spark = docs.sparkSession
    whole = F.broadcast(known_licences(spark, texts).withColumnRenamed("name", "license"))  # as many rows as known texts
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    listed = known_licences(spark, notices).agg(F.map_from_entries(F.collect_list(F.struct("digest", "name"))).alias("by_digest"))
    begins = _begins(spark, notices)
    maybe = F.filter(lines, lambda line: F.lower(line).rlike(begins))
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col).cast("string")), 256).alias("digest"), maybe.alias("_lines")).crossJoin(F.broadcast(listed))
    found = F.transform("_lines", lambda line: F.element_at("by_digest", F.sha2(canonical(line), 256)))
    out = rows.select(id_col, "digest", F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNotNull()))), ",").alias("notices"))
    return out.join(whole, "digest", "left").select(id_col, "digest", "license", "notices")
