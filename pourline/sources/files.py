"""Sitemaps, cached pages and evaluation sets as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable

_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _bad string"


def read_sitemaps(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(site, url, sitemap_source) of local sitemap files, .xml or .xml.gz; the source is the file's name."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return rows.where("loc IS NOT NULL").select(F.lit(site).alias("site"), F.trim("loc").alias("url"), F.col("_metadata.file_name").alias("sitemap_source"))


def looks_like_sitemap(xml: Column) -> Column:
    """Whether a fetched text is XML or a sitemap by its first characters."""
    head = F.ltrim(xml)
    return F.substring(head, 1, 100).contains("<?xml") | F.substring(head, 1, 200).rlike("<urlset|<sitemapindex")


def parsed_sitemaps(docs: DataFrame) -> DataFrame:
    """docs(url, xml) -> (doc, children, pages): the locations of the child sitemaps and of the pages of each sitemap.

    XML is parsed as a record of its own with its errors kept beside it, so a text that is no XML, breaks off, has a bare
    ``&`` or an entity that XML does not know gives no row and stops nothing.  Entities that a document declares itself
    are not expanded: it counts as malformed.  Namespaces and their prefixes are passed over.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
    read = docs.where(looks_like_sitemap(F.col("xml"))).select(F.col("url").alias("doc"), F.from_xml("xml", _SITEMAP, options).alias("x"))
    locs = lambda items: F.filter(F.transform(F.coalesce(items, F.array().cast("array<struct<loc:string>>")), lambda i: F.trim(i["loc"])), lambda t: t != "")
    return read.where("x._bad IS NULL").select("doc", locs(F.col("x.sitemap")).alias("children"), locs(F.col("x.url")).alias("pages"))


def expand_sitemap_index(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """docs(url, xml), roots(url) -> (url, sitemap_source): page urls with the leaf sitemap that lists them.

    A document with child sitemaps is an index and is followed; else its urls are
    given.  Missing and malformed documents add nothing.  Each level is one equi-join, and
    levels follow until one names no new document.
    """
    known = parsed_sitemaps(docs)
    frontier, visited, out = roots.select(F.col("url").alias("doc")).distinct(), None, None
    while True:
        level = durable(known.join(frontier, "doc", "left_semi"))
        pages = level.where(F.size("children") == 0).select(F.explode("pages").alias("url"), F.col("doc").alias("sitemap_source"))
        out = pages if out is None else out.unionByName(pages)
        visited = frontier if visited is None else visited.unionByName(frontier)
        frontier = durable(level.select(F.explode("children").alias("doc")).distinct().join(visited, "doc", "left_anti"))
        if frontier.isEmpty():
            break
    return out


def read_eval_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation entries, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_html_tree(spark: SparkSession, root: str) -> DataFrame:
    """(html_path, html) of a cache tree root/site/name.html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("html_path"), F.decode("content", "UTF-8").alias("html"))


def write_html_cache(pages: DataFrame, path: str) -> None:
    """Cached pages (site, url, html_path, html) as Parquet by site; a site of any size is spread over its tasks' files."""
    pages.select("site", "url", "html_path", "html").write.mode("append").partitionBy("site").parquet(path)


def write_bucketed_cache(pages: DataFrame, table: str, buckets: int) -> None:
    """Cached pages (html_path, html, …) as a table in buckets by html_path, sorted within them.

    A join on html_path reads the buckets as they lie; ``buckets`` is the cache's size over what a task should read.
    """
    pages.repartition(buckets, "html_path").write.mode("overwrite").bucketBy(buckets, "html_path").sortBy("html_path").saveAsTable(table)
