"""Readers of captured sites, batch configurations and earlier results; interfaces of live fetchers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.columns import nullif_empty

#: Timestamp of captures read from a folder. Fixed value.
CAPTURED_AT = "2026-06-01T00:00:00+00:00"


class Fetcher(Protocol):
    """A live source of pages; a fetch never raises, a failed one has status 0 and a ``fetch_failed`` warning."""

    def fetch(self, url: str) -> dict: ...


class UnavailableFetcher:
    """Stands for a connector whose dependency is missing."""

    def __init__(self, dependency: str):
        self.dependency = dependency

    def fetch(self, url: str) -> dict:
        return {"url": url, "final_url": url, "status": 0, "text": "", "links": [], "warnings": [{"code": "optional_dependency_missing", "message": f"{self.dependency} is not installed", "source_urls": [url]}]}


def fetched(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """Pages of a frontier by a fetcher, in parallel over partitions; an exception is a failed row."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    page = fetcher.fetch(url)
                except Exception as e:  # a fetch must not end the scan
                    page = {"status": 0, "warnings": [{"code": "fetch_failed", "message": str(e)}]}
                codes = [w["code"] for w in page.get("warnings", [])]
                if page.get("status", 0) >= 400 and not codes:
                    codes = ["fetch_failed"]
                rows.append((url, page.get("final_url", url), int(page.get("status", 0)), page.get("text", ""), list(page.get("links", [])), codes))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "text", "links", "warnings"])

    return urls.select("url").mapInPandas(run, "url string, final_url string, status int, text string, links array<string>, warnings array<string>")


def read_site(spark: SparkSession, root: str, base_url: str) -> DataFrame:
    """A folder of captured files as pages: path to URL (``index.html`` is its folder; a top folder with a dot in its
    name is another host), type by suffix, title, text, links and content hash. ``rel`` is the path in the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "^/+", "")
    first = F.regexp_extract(rel, "^([^/]+)/", 1)
    other_host = first.rlike(r"\.[a-z]{2,}$")
    url = F.when(other_host, F.concat(F.lit("https://"), rel)).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), rel))
    url = F.regexp_replace(url, r"index\.html$", "")
    kind = F.when(rel.endswith(".pdf"), "pdf").when(rel.endswith(".json"), "json").when(rel.rlike(r"\.html?$"), "html").otherwise("other")
    pages = files.select(rel.alias("rel"), url.alias("url"), kind.alias("source_type"), F.decode("content", "UTF-8").alias("raw"))
    none = F.array().cast("array<string>")
    is_html = F.col("source_type") == "html"
    pages = pages.withColumn("text", F.when(is_html, T.html_text(F.col("raw"))).otherwise(F.col("raw")))
    return pages.select("rel", "url", F.lit(200).alias("status"), "source_type", F.lit(CAPTURED_AT).alias("retrieved_at"), F.when(is_html, T.title(F.col("raw"))).alias("title"), "text", F.when(is_html, T.links(F.col("raw"))).otherwise(none).alias("links"), T.academic_year(F.col("text")).alias("academic_year"), T.content_hash(F.col("raw")).alias("content_hash"), none.alias("warnings"))


def site_path(url: Column, base_url: str) -> Column:
    """Where a folder keeps an address: its path, under its host's name if that isn't the base's; queries and fragments
    don't count, and null stands for what would be outside of the folder."""
    own = F.split(F.lit(base_url), "/")[2]
    web = F.lower(U.part(url, 1)).isin("http", "https")
    route = F.regexp_replace(F.when(web & (U.part(url, 2) != own), F.concat(U.part(url, 2), U.part(url, 3))).when(web, U.part(url, 3)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1)), "^/+", "")

    def step(state: Column, s: Column) -> Column:
        taken = F.when(s.isin("", "."), state["taken"]).when(s == "..", F.slice(state["taken"], 1, F.greatest(F.size(state["taken"]) - 1, F.lit(0)))).otherwise(F.array_append(state["taken"], s))
        return F.struct(taken.alias("taken"), (state["out"] | ((s == "..") & (F.size(state["taken"]) == 0))).alias("out"))

    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(False).alias("out"))
    walked = F.aggregate(F.split(route, "/"), start, step, lambda s: F.when(~s["out"], F.array_join(s["taken"], "/")))
    return F.when(F.lower(U.part(url, 1)) == "file", F.lit(None).cast("string")).otherwise(walked)


def fetched_from(site: DataFrame, requests: DataFrame, base_url: str) -> DataFrame:
    """A page for each requested ``url`` from ``read_site``: the file of its path, or the folder's ``index.html``; a row
    with status 404 and a ``fetch_failed`` warning where there is none."""
    asked = requests.select("url", site_path(F.col("url"), base_url).alias("_at")).withColumn("final_url", F.regexp_extract("url", "^([^?#]*)", 1))
    folder = F.concat(F.col("_at"), F.when(F.col("_at") == "", "").otherwise("/"), F.lit("index.html"))
    files = site.drop("url", "status", "warnings")
    tried = asked.select("*", F.posexplode(F.array(F.col("_at"), folder)).alias("_k", "rel")).join(files, "rel")
    best = tried.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("_k"))).where("_n = 1").drop("_n", "_k", "_at", "final_url", "rel")
    found = F.col("content_hash").isNotNull()
    out = asked.drop("_at").distinct().join(best, "url", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"status": F.when(found, 200).otherwise(404), "warnings": F.when(found, none).otherwise(F.array(F.lit("fetch_failed"))), "links": F.coalesce("links", none), "retrieved_at": F.lit(CAPTURED_AT)})


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Batch configuration: an object with ``universities``, a list, or one object; seeds under any of three names."""
    fields = "id string, name string, seed_urls array<string>, seeds array<string>, seed_url string, max_pages int, max_depth int"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"))
    wrapped = F.from_json("v", f"struct<universities:array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>>")["universities"]
    single = F.array(F.from_json("v", f"struct<{fields.replace(' ', ':').replace(',:', ',')}>"))
    rows = raw.select(F.inline(F.coalesce(listed, wrapped, single)))
    seeds = F.coalesce("seed_urls", "seeds", F.when(F.col("seed_url").isNotNull(), F.array("seed_url")))
    checked = rows.withColumn("seed_urls", seeds).withColumn("id", F.coalesce(nullif_empty(F.col("id")), slug(F.col("name"))))
    ok = F.col("name").isNotNull() & (F.size(F.coalesce("seed_urls", F.array())) > 0)
    return checked.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("a university needs a name and a seed URL")).cast("string"))).select("id", "name", "seed_urls", "max_pages", "max_depth")


def read_previous(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Sources of an earlier result (source_url, content_hash), or None where there is none."""
    from pyspark.errors import AnalysisException

    if not path:
        return None
    try:
        return spark.read.option("multiLine", True).schema("sources array<struct<source_url:string,content_hash:string>>").json(path).select(F.inline("sources"))
    except AnalysisException:
        return None
