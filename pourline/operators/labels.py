"""URL labels: requests and responses of a labeller, rules, samples and review."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable
from .state import set_content_type, unclassified_queue, upsert_latest

#: The labels a labeller may give.
LABELS = (
    "likely_cocktail_adjacent", "likely_drink_article", "likely_drink_recipe", "likely_food_article",
    "likely_food_recipe", "likely_junk", "likely_unstructured_drink_recipe", "likely_user_generated",
)


def label_message_col(url: Column, sitemap_source: Column) -> Column:
    """The two-line request for one page."""
    source = F.when(F.coalesce(sitemap_source, F.lit("")) == "", F.lit("(none)")).otherwise(sitemap_source)
    return F.concat(F.lit("URL: "), url, F.lit("\nSitemap: "), source)


def parse_label_response(raw: Column) -> Column:
    """The label of a raw JSON response; null where it is no JSON object or names no known label."""
    label = F.try_variant_get(F.try_parse_json(raw), "$.label", "string")
    return F.when(label.isin(*LABELS), label)


@dataclass(frozen=True)
class Rule:
    """Pages for which ``matches`` holds get ``label``; a rule with ``now`` asks for that label before."""

    key: str
    matches: Column
    label: str
    now: str | None = None


def _path(site: str, *patterns: str) -> Column:
    any_of = F.lit(False)
    for p in patterns:
        any_of = any_of | F.col("url").ilike(f"%{p}%")
    return (F.col("site") == site) & any_of


def default_rules() -> list[Rule]:
    """The relabel rules, in order (LIKE without regard to ASCII case)."""
    sections = "bars books bws cocktails events people productsandservices simons-blog".split()
    return [
        Rule("diffordsguide_encyclopedia_cocktail_adjacent", _path("diffordsguide", *[f"/encyclopedia/%/{s}/" for s in sections]), "likely_cocktail_adjacent"),
        Rule("diffordsguide_encyclopedia_junk", _path("diffordsguide", "/encyclopedia/%/company-info/", "/encyclopedia/%/competitions/"), "likely_junk"),
        Rule("foodnetwork_videos_junk", _path("foodnetwork", "/videos/"), "likely_junk"),
        Rule("imbibe_dotw_drink_article", _path("imbibe", "/drink-of-the-week-"), "likely_drink_article"),
        Rule("foodnetwork_recipes_articles_food_article", _path("foodnetwork", "/recipes/articles/"), "likely_food_article", "likely_food_recipe"),
        Rule("foodnetwork_recipes_articles_drink_article", _path("foodnetwork", "/recipes/articles/"), "likely_drink_article", "likely_drink_recipe"),
        Rule("bonappetit_story_unstructured_drink_recipe", _path("bonappetit", "/story/"), "likely_unstructured_drink_recipe", "likely_drink_recipe"),
    ]


def sitemap_rule(key: str, sitemap: str, label: str) -> Rule:
    """A rule for all pages of one sitemap."""
    return Rule(key, F.col("sitemap_source") == sitemap, label)


def reclassify(pages: DataFrame, rules: list[Rule] | None = None, keys: list[str] | None = None, dry_run: bool = False) -> DataFrame:
    """pages with new_type, the last rule that fired (fired_key), the label before that rule, and all fired keys.

    Rules apply in order and later ones see earlier changes, in one pass: a fold over
    the rules' matches carries the current label.  In a dry run each rule is held
    against the unchanged label.
    """
    rules = [r for r in rules or default_rules() if keys is None or r.key in keys]
    text, texts = "string", "array<string>"
    entries = [
        F.struct(F.coalesce(r.matches, F.lit(False)).alias("m"), F.lit(r.label).alias("label"), F.lit(r.now).cast(text).alias("now"), F.lit(r.key).alias("key"))
        for r in rules
    ]
    made = lambda now, before, key, fired: F.struct(
        now.cast(text).alias("now"), before.cast(text).alias("before"), key.cast(text).alias("key"), fired.cast(texts).alias("fired")
    )
    start = made(F.col("content_type"), F.lit(None), F.lit(None), F.array())

    def apply(a: Column, x: Column) -> Column:
        current = F.col("content_type") if dry_run else a["now"]
        hit = x["m"] & (x["now"].isNull() | F.coalesce(current == x["now"], F.lit(False))) & ~current.eqNullSafe(x["label"])
        fired = F.concat(a["fired"], F.array(x["key"]))
        changed = made(a["now"], a["before"], a["key"], fired) if dry_run else made(x["label"], a["now"], x["key"], fired)
        return F.when(hit, changed).otherwise(a)

    out = pages.withColumn("_rules", F.aggregate(F.array(*entries), start, apply) if entries else start)
    names = {"new_type": "now", "before_type": "before", "fired_key": "key", "fired_keys": "fired"}
    return out.withColumns({k: F.col(f"_rules.{v}") for k, v in names.items()}).drop("_rules")


def rule_counts(reclassified: DataFrame) -> DataFrame:
    return reclassified.select(F.explode("fired_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def audit_rows(reclassified: DataFrame, now) -> DataFrame:
    """The label runs that rules write: model and version 'manual', no run id."""
    return reclassified.where("fired_key IS NOT NULL").select(
        F.col("id").alias("page_id"), F.lit(None).cast("long").alias("run_id"), F.col("new_type").alias("label"), F.lit("manual").alias("model"),
        F.lit("manual").alias("prompt_version"),
        F.concat(F.lit('{"label": "'), F.col("new_type"), F.lit('", "key": "'), F.col("fired_key"), F.lit('"}')).alias("raw_response"),
        F.lit(now).cast("timestamp").alias("evaluated_at"), F.col("before_type").alias("pages_content_type_before"),
    )


def null_labels(pages: DataFrame, rules: list[Rule], keys: list[str] | None = None) -> DataFrame:
    """Labels of matching pages become null."""
    hit = F.lit(False)
    for r in rules:
        if keys is None or r.key in keys:
            hit = hit | F.coalesce(r.matches, F.lit(False))
    return pages.withColumn("content_type", F.when(~hit, F.col("content_type")))


def _answers(labeller: Callable[[str], str], in_flight: int, tries: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Ask the labeller about every row with ``in_flight`` calls of the task under way at most, in the rows' order."""

    def ask(message: str) -> tuple[str | None, str | None, int]:
        began, error = time.monotonic(), None
        for _ in range(tries):
            try:
                return labeller(message), None, round(1000 * (time.monotonic() - began))
            except Exception as failure:  # whatever the caller's function raises is that row's error
                error = f"{type(failure).__name__}: {failure}"
        return None, error, round(1000 * (time.monotonic() - began))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                found = []
                for at in range(0, len(b), 16 * in_flight):  # calls of so many rows wait at a time
                    found += pool.map(ask, b["message"].iloc[at : at + 16 * in_flight])
                raw, error, took = zip(*found, strict=True) if found else ((), (), ())
                yield pd.DataFrame({"id": b["id"], "before": b["content_type"], "raw": pd.Series(raw, b.index, object), "error": pd.Series(error, b.index, object), "latency_ms": pd.Series(took, b.index, "int64")})

    return run


def label_urls(
    pages: DataFrame, runs: DataFrame, extract_runs: DataFrame, labeller: Callable[[str], str],
    model: str, version: str, run_id: int, now, limit: int | None = None, site: str | None = None, in_flight: int = 4, tries: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Label the unclassified queue with a caller's function from a request text to a raw response.

    Returns (pages, runs, extract_runs, asked); asked(id, raw, error, label, latency_ms) has every row of the queue.  A call
    that raises is made ``tries`` times; its row then keeps the error and stays unlabelled, as does one whose response
    names no known label.  A queue with rows and no label at all is an error.
    """
    queue = pages.where(F.col("content_type").isNull() & (F.lit(True) if site is None else F.col("site") == site))
    if limit:
        queue = unclassified_queue(pages, site, limit)  # only a limit needs the order
    queue = queue.select("id", "content_type", label_message_col(F.col("url"), F.col("sitemap_source")).alias("message"))
    # The labeller is asked once for each row: its answers are written before anything reads them.
    answered = queue.mapInPandas(_answers(labeller, in_flight, tries), "id long, before string, raw string, error string, latency_ms long")
    answered = durable(answered.withColumn("label", parse_label_response(F.col("raw"))))
    seen = answered.agg(F.count("*").alias("n"), F.count("label").alias("good"), F.min("error").alias("error")).first()
    if seen["n"] and not seen["good"]:
        raise RuntimeError(f"no label for any of {seen['n']} urls" + (f"; one error is {seen['error']}" if seen["error"] else ""))
    good = answered.where("label IS NOT NULL")
    new_runs = good.select(
        F.col("id").alias("page_id"), F.lit(run_id).cast("long").alias("run_id"), "label", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"),
        F.col("raw").alias("raw_response"), "latency_ms", F.lit(now).cast("timestamp").alias("evaluated_at"), F.col("before").alias("pages_content_type_before"),
    )
    out, left = set_content_type(pages, extract_runs, good.select("id", F.col("label").alias("new_type")))
    return out, upsert_latest(runs, new_runs, "page_id", [F.col("page_id")]), left, answered.select("id", "raw", "error", "label", "latency_ms")


def label_counts(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Labels per site of the given urls; a page without one counts as classify_error."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi").groupBy("site", F.coalesce("content_type", F.lit("classify_error")).alias("label")).agg(F.count("*").alias("n"))


def sample_labels(runs: DataFrame, pages: DataFrame, n: int, seed: str, site: str | None = None, label: str | None = None) -> DataFrame:
    """n rows in the order of a seeded hash: a random sample that comes out the same each time, kept by top-k and not by a full sort."""
    rows = runs.join(pages.select(F.col("id").alias("page_id"), "site", "url"), "page_id")
    if site is not None:
        rows = rows.where(F.col("site") == site)
    if label is not None:
        rows = rows.where(F.col("label") == label)
    return rows.orderBy(F.md5(F.concat(F.col("page_id").cast("string"), F.lit(seed))), "page_id").limit(n)


def lookup_labels(urls: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """urls(pos, url) in order, each with its page's label or nulls; repeated urls stay."""
    known = pages.select("id", "url")
    return urls.join(known, "url", "left").join(runs.select(F.col("page_id").alias("id"), "label"), "id", "left").select("pos", "url", "id", "label").orderBy("pos")


def review_labels(expected: DataFrame, predicted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(total, correct, pct) and the failures (key, expected, predicted)."""
    both = expected.select(key, "expected").join(predicted.select(key, "predicted"), key, "left")
    right = F.col("expected").eqNullSafe(F.col("predicted"))
    report = both.agg(F.count("*").alias("total"), F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("correct")).withColumn(
        "pct", F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")).otherwise(0.0)
    )
    return report, both.where(~right)
