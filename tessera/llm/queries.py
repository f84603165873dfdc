"""Thin queries over this subpackage's operators: whole tables, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import table
from tessera.llm.decontamination import contaminated_windows
from tessera.llm.embedding_dedup import embedding_duplicates
from tessera.llm.licence_texts import NOTICES, SPELLINGS, TEXTS
from tessera.llm.licences import PROSE, license_scan
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_sequences
from tessera.llm.quality import quality_scores
from tessera.llm.revisits import resolved_revisits
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_tree import suffix_tree_scores
from tessera.llm.toxicity import fit_chain, score

#: A document is rejected from this probability of toxicity on.
TOXIC_AT = 0.8
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with p_low_quality and p_toxic, by a chain fitted on all labels' sample."""
    chain = fit_chain(docs, labels, [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))])
    return score(docs, chain)


def op1_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, F.col("quality"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of the pages: every page a full response and a revisit five seconds later, with validators by
    page; a third have a newer response in between, and an eleventh a revisit before their first response."""
    tag, day = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), F.col("page_id"))
    size, kind = F.length("html").cast("string"), F.col("page_id") % 5
    base = pages.select("page_id", "url", tag.alias("tag"), day.alias("day"), size.alias("size"), kind.alias("k"))
    null = F.lit(None).cast("string")
    revisit_tag = F.when(F.col("k") == 0, F.col("tag")).when(F.col("k") == 1, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("k") == 3, F.lit('"other"'))
    response = lambda etag: F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), F.col("day"), F.lit("Content-Length"), F.col("size"), F.lit("Cache-Control"), F.lit("max-age=60"))
    headers = F.map_filter(F.create_map(F.lit("ETag"), revisit_tag, F.lit("Last-Modified"), F.when(F.col("k") == 2, F.col("day")).otherwise(null), F.lit("Date"), F.concat(F.lit("seen "), F.col("page_id")), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=120")), lambda _, v: v.isNotNull())
    record = lambda n, at, kind, headers, when: F.when(when, F.struct((F.col("page_id") * 4 + n).alias("record_id"), "url", (F.col("page_id") * 10 + at).alias("captured"), F.lit(kind).alias("kind"), headers.alias("headers")))
    always = F.lit(True)
    made = F.array(record(0, 0, "response", response(F.col("tag")), always), record(1, 5, "revisit", headers, always), record(2, -3, "revisit", headers, F.col("page_id") % 11 == 0), record(3, 4, "response", response(F.lit('"newer"')), F.col("page_id") % 3 == 0))
    return base.select(F.inline(F.filter(made, lambda r: r.isNotNull())))


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolved_revisits(page_records(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), "; ")
    return out.withColumn("headers", shown)


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC_AT).alias("rejected"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"), F.expr("crc32(cast(doc_id as string)) % 7 = 2"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed", "text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
first AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT win.doc_id, k AS p FROM win JOIN first USING (h), unnest(range(i, i + 50)) AS t(k) WHERE win.doc_id > lo),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


OP1_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (WITH RECURSIVE r AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(reach.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(reach.b, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS c ON v.vec_id = c.a LEFT JOIN reach ON v.vec_id = reach.a
"""

OP3_SQL = r"""
WITH parts AS (SELECT page_id, '"' || md5(html) || '"' AS tag, 'day ' || page_id AS day, CAST(length(html) AS VARCHAR) AS size, page_id % 5 AS k,
  regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$', '', 'g')
  || rtrim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/') AS place,
  regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 2), '(^|&)(utm_[^&=]*|ref)(=[^&]*)?(?:(&)(utm_[^&=]*|ref)(=[^&]*)?)*($|&)', '\1\7', 'g'), '^&|&$', '', 'g') AS query FROM pages),
base AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM parts),
full_ AS (SELECT page_id * 4 AS id, url_key, page_id * 10 AS captured, tag, day, size FROM base UNION ALL SELECT page_id * 4 + 3, url_key, page_id * 10 + 4, '"newer"', day, size FROM base WHERE page_id % 3 = 0),
stored AS (SELECT url_key, captured, max(id) AS id, arg_max(tag, id) AS tag, arg_max(day, id) AS day, arg_max(size, id) AS size FROM full_ GROUP BY ALL HAVING true),
revisits AS (SELECT page_id * 4 + 1 AS id, page_id * 10 + 5 AS captured, * EXCLUDE (tag, day, size), CASE k WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"other"' END AS tag, CASE WHEN k = 2 THEN day END AS day FROM base
  UNION ALL SELECT page_id * 4 + 2, page_id * 10 - 3, * EXCLUDE (tag, day, size), CASE k WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"other"' END, CASE WHEN k = 2 THEN day END FROM base WHERE page_id % 11 = 0),
joined AS (SELECT r.id AS record_id, r.url_key, r.captured, r.page_id, r.tag, r.day, s.id AS sid, s.tag AS stag, s.day AS sday, s.size AS ssize FROM revisits r ASOF LEFT JOIN stored s ON r.url_key = s.url_key AND r.captured > s.captured),
judged AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_earlier_response' WHEN tag IS NULL AND day IS NULL THEN 'no_validator'
  WHEN CASE WHEN tag IS NOT NULL THEN regexp_replace(tag, '^[Ww]/', '') = stag ELSE day = sday END THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM joined)
SELECT record_id, url_key, captured, status, CASE WHEN status = 'resolved' THEN sid END AS response_id,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=120; content-length=' || ssize || '; date=seen ' || page_id || '; etag=' || coalesce(tag, stag) || '; last-modified=' || coalesce(day, sday) END AS headers FROM judged
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """Lines by themselves, where the operator has one pattern for all of a text."""
    start = "regexp_replace(line, '^[ \\t#*/;-]*', '')"
    rest = f"regexp_extract({start}, '^copyright(.*)$', 1)"
    holder = f"(starts_with({start}, 'copyright') AND regexp_matches({rest}, '^[ \\t:]*[^\\s:]') AND NOT regexp_matches({rest}, '^[ \\t]+({'|'.join(PROSE)})([^a-z0-9_]|$)'))"
    dropped = f"({holder} OR regexp_matches({start}, '^(\\(c\\)[ \\t]*(copyright([^a-z0-9_]|$)|[0-9][0-9][0-9][0-9])|©|all rights reserved)'))"
    out = f"array_to_string(list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda line: CASE WHEN {dropped} THEN ' ' ELSE line END), chr(10))"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for other, one in SPELLINGS * 2:
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"trim({out})"


def _sql_known(texts: dict[str, str]) -> str:
    rows = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in sorted(texts.items()))
    return f"(SELECT min(name) AS name, digest FROM (SELECT name, sha256({_sql_canonical('body')}) AS digest FROM (VALUES {rows}) AS t(name, body)) GROUP BY digest)"


def license_sql() -> str:
    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, k.name FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE regexp_matches(line, '(?i)licen[cs]|public domain')) JOIN {_sql_known(NOTICES)} AS k USING (digest)),
named AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM found GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.name AS license, coalesce(named.notices, '') AS notices FROM (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents) AS d
LEFT JOIN {_sql_known(TEXTS)} AS k USING (digest) LEFT JOIN named ON d.doc_id = named.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_epsilon_grid_join": OP1_SQL, "op3_revisit_resolution": OP3_SQL, "op6_license_digests": license_sql(), "op10_substring_dedup": OP10_SQL}
