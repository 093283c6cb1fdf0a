"""Recipe extraction: first recipe of each queued page, promoted columns, outcomes and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.page_facts import page_facts
from ..shared import durable
from .state import extract_queue, upsert_latest
from .validation import join_html_cache

EXTRACTOR_VERSION = "v1"
PUBLIC = ("id", "source_url", "site", "name", "author", "image_url", "jsonld")


def recipe_rows(pages: DataFrame) -> DataFrame:
    """One row per recipe of pages(…, facts): JSON-LD first, then microdata, with its place."""
    rest = [c for c in pages.columns if c != "facts"]
    return pages.select(*rest, F.posexplode("facts.recipes").alias("ordinal", "recipe"))


def first_recipe(pages: DataFrame) -> DataFrame:
    """pages(…, facts) -> with the first recipe or null."""
    return pages.withColumn("recipe", F.get("facts.recipes", F.lit(0)))


def extract_recipes(
    pages: DataFrame, cache: DataFrame, extract_runs: DataFrame, recipes: DataFrame, run_id: int, now, site: str | None = None, limit: int | None = None
) -> dict[str, DataFrame]:
    """Extract the queue: recipes, extract_runs, and outcomes per page (extracted, no_recipe, html_missing)."""
    joined = join_html_cache(extract_queue(pages, extract_runs, recipes, site, limit), cache)
    found = first_recipe(joined.withColumn("facts", page_facts(F.col("html")))).withColumn(
        "outcome", F.when(F.col("html").isNull(), "html_missing").when(F.col("recipe").isNull(), "no_recipe").otherwise("extracted")
    ).drop("html", "facts")
    found = durable(found)  # four results read it; pages are parsed once
    runs = found.select(
        F.col("id").alias("page_id"), F.lit(run_id).cast("long").alias("run_id"), "outcome", F.lit(None).cast("string").alias("error"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit(now).cast("timestamp").alias("evaluated_at"),
    )
    new = found.where("outcome = 'extracted'").select(
        F.col("url").alias("source_url"), "site", F.col("recipe.derived_name").alias("name"), F.col("recipe.author").alias("author"),
        F.col("recipe.image_url").alias("image_url"), F.col("recipe.json").alias("jsonld"), F.lit(now).cast("timestamp").alias("fetched_at"),
    )
    return {
        "outcomes": found.select("id", "site", "url", "outcome"),
        "extract_runs": upsert_latest(extract_runs, runs, "page_id", [F.col("page_id")]),
        "recipes": upsert_recipes(recipes, new, now),
        "new_recipes": new,
    }


def upsert_recipes(existing: DataFrame, new: DataFrame, now) -> DataFrame:
    """By source_url: a known recipe keeps its id and takes all other columns; a new one's id hashes its url."""
    ids = existing.select("source_url", F.col("id").alias("_id"))
    rows = new.join(ids, "source_url", "left").withColumn("id", F.coalesce("_id", F.xxhash64("source_url"))).withColumn("extracted_at", F.lit(now).cast("timestamp"))
    return upsert_latest(existing, rows.select(*existing.columns), "source_url", [F.desc("fetched_at"), F.col("jsonld")])


def extract_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("site", "outcome").agg(F.count("*").alias("n"))


def recipes_public(recipes: DataFrame) -> DataFrame:
    return recipes.select(*PUBLIC)


def extracted_source_urls(recipes: DataFrame, site: str | None = None) -> DataFrame:
    return (recipes if site is None else recipes.where(F.col("site") == site)).select("source_url")


def count_recipes(recipes: DataFrame) -> DataFrame:
    return recipes.agg(F.count("*").alias("n"))
