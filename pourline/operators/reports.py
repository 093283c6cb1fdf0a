"""Counts for people: status by site, changes by site, a fetch's outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_status_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site", "status").agg(F.count("*").alias("n"))


def run_summary(changes: DataFrame) -> DataFrame:
    """changes(site, category) -> counts per site and category, and a grand total under null."""
    per = changes.groupBy("site", "category").agg(F.count("*").alias("n"))
    total = per.agg(F.lit(None).cast("string").alias("site"), F.lit(None).cast("string").alias("category"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return per.unionByName(total).orderBy(F.asc_nulls_last("site"), F.desc("n"), "category")


def fetch_summary(results: DataFrame, breaker: DataFrame | None = None) -> DataFrame:
    """results(site, status, error) -> counts by outcome (errors as one), and paused sites by name."""
    out = results.groupBy(F.when(F.col("error").isNotNull(), F.lit("errors")).otherwise(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))
    if breaker is None:
        return out
    return out.unionByName(breaker.where("paused").select(F.concat(F.lit("paused:"), F.col("site").cast("string")).alias("outcome"), F.lit(1).cast("long").alias("n")))
