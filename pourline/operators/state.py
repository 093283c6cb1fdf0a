"""Frontier and evaluation state: queues, transitions and latest-only tables.

Tables are DataFrames and an operator returns the new table.  Ids in results come
from the data; ``now`` and ``run_id`` are arguments, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import durable

#: Labels of pages whose recipes are extracted.
EXTRACTABLE = ("likely_drink_recipe", "confirmed_drink")
MAX_ATTEMPTS = 3
#: The version column of each evaluation table.
EVAL_TABLES = {
    "classify_url_runs": "prompt_version",
    "validate_html_runs": "validator_version",
    "classify_drink_runs": "scorer_version",
    "extract_runs": "extractor_version",
}


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def _at(site: str | None) -> Column:
    return F.lit(True) if site is None else F.col("site") == site


def add_urls(pages: DataFrame, new: DataFrame, order: list[str], now) -> DataFrame:
    """New frontier rows: the first of each url in the batch, unless the frontier has the url at any site.

    Equal urls meet in one group, whose first row a partial minimum finds before the
    shuffle; ids go on after the largest one, in batch order.
    """
    rest = [c for c in new.columns if c not in order and c != "url"]
    first = new.groupBy("url").agg(F.min(F.struct(*order, *rest)).alias("x")).select("url", "x.*")
    fresh = first.join(pages.select("url"), "url", "left_anti")
    start = pages.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    # Ids without one global window: ranks within ranges of the order, and the sum of the ranges before.  The ranges are
    # written first: their bounds are sampled, and two readers of the plan would each sample their own.
    ranged = durable(fresh.repartitionByRange(*order, "url").withColumn("part", F.spark_partition_id()))
    within = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order, "url")))
    sizes = within.groupBy("part").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("part", "before")), "part").join(F.broadcast(start)).select(
        (F.col("top") + F.col("before") + F.col("n")).cast("long").alias("id"), "site", "url", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("content_type"), "sitemap_source", F.lit(0).alias("attempts"), F.lit(now).cast("timestamp").alias("discovered_at"),
    )


def new_by_site(added: DataFrame) -> DataFrame:
    """Rows that ``add_urls`` gave each site; sites without a new row are not listed."""
    return added.groupBy("site").agg(F.count("*").alias("n_new"))


def pending_queue(pages: DataFrame, site: str | None = None, limit: int | None = None, content_type: str | None = None) -> DataFrame:
    held = (F.col("status") == "pending") & F.col("disabled_reason").isNull() & _at(site)
    if content_type:
        held = held & (F.col("content_type") == content_type)
    return _limited(pages.where(held).orderBy("site", "discovered_at", "id"), limit)


def unclassified_queue(pages: DataFrame, site: str | None = None, limit: int | None = None) -> DataFrame:
    return _limited(pages.where(F.col("content_type").isNull() & _at(site)).orderBy("id"), limit)


def count_unclassified(pages: DataFrame, site: str | None = None) -> DataFrame:
    return pages.where(F.col("content_type").isNull() & _at(site)).agg(F.count("*").alias("n"))


def pages_by_content_type(pages: DataFrame, content_type: str, site: str | None = None, limit: int | None = None) -> DataFrame:
    return _limited(pages.where((F.col("content_type") == content_type) & _at(site)).orderBy("site", "discovered_at", "id"), limit)


def validate_queue(pages: DataFrame, validate_runs: DataFrame, drink_runs: DataFrame, site: str | None = None, limit: int | None = None) -> DataFrame:
    """Cached pages that lack either evaluation, so a half-evaluated page comes again."""
    both = validate_runs.select("page_id").join(drink_runs.select("page_id"), "page_id", "left_semi")
    rows = pages.where(F.col("html_path").isNotNull() & _at(site)).select("id", "site", "url", "status", "content_type", "html_path")
    return _limited(rows.join(both, rows["id"] == both["page_id"], "left_anti").orderBy("site", "id"), limit)


def extract_queue(pages: DataFrame, extract_runs: DataFrame, recipes: DataFrame, site: str | None = None, limit: int | None = None) -> DataFrame:
    """Extractable cached pages without a failure on record and without a stored recipe; the limit counts after both."""
    rows = pages.where(F.col("content_type").isin(*EXTRACTABLE) & F.col("html_path").isNotNull() & _at(site)).select("id", "site", "url", "content_type", "html_path")
    failed = extract_runs.where("outcome <> 'extracted'").select("page_id")
    stored = recipes.select("source_url")
    left = rows.join(failed, rows["id"] == failed["page_id"], "left_anti")
    return _limited(left.join(stored, left["url"] == stored["source_url"], "left_anti").orderBy("id"), limit)


def set_content_type(pages: DataFrame, extract_runs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates(id, new_type) -> (pages, extract_runs); a page that becomes extractable sheds its failures.

    Of several updates of one page the last in the order of the types counts.
    """
    new = updates.groupBy(F.col("id").alias("_id")).agg(F.max("new_type").alias("new_type"))
    joined = pages.join(new, pages["id"] == new["_id"], "left")
    out = joined.withColumn("content_type", F.when(F.col("_id").isNotNull(), F.col("new_type")).otherwise(F.col("content_type"))).select(*pages.columns)
    known = new.where(F.col("new_type").isin(*EXTRACTABLE)).select("_id")
    stale = extract_runs.where("outcome <> 'extracted'").join(known, F.col("page_id") == F.col("_id"), "left_semi").select(F.col("page_id").alias("_stale"))
    kept = extract_runs.join(stale, (extract_runs["page_id"] == stale["_stale"]) & (extract_runs["outcome"] != "extracted"), "left_anti")
    return out, kept


def set_content_type_by_url(pages: DataFrame, extract_runs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """set_content_type for updates(url, new_type); urls that no page has change nothing."""
    known = updates.groupBy("url").agg(F.max("new_type").alias("new_type"))
    return set_content_type(pages, extract_runs, pages.select("id", "url").join(known, "url").select("id", "new_type"))


def apply_fetch_results(pages: DataFrame, results: DataFrame, now) -> DataFrame:
    """results(url, error, new_status, new_path): errors count attempts and fail at the third; others set status and path.

    Of several results of one url every error counts, and a page counts before errors:
    the last in the order of status and path; of errors the last in their order is kept.
    """
    page = F.when(F.col("error").isNull(), F.struct("new_status", "new_path"))
    new = (
        results.groupBy(F.col("url").alias("_url"))
        .agg(F.max("error").alias("error"), F.count("error").alias("_errors"), F.max(page).alias("_page"))
        .select("_url", "error", "_errors", F.col("_page").isNotNull().alias("_good"), "_page.new_status", "_page.new_path")
    )
    joined = pages.join(new, pages["url"] == new["_url"], "left")
    hit, bad, good = F.col("_url").isNotNull(), F.col("error").isNotNull(), F.coalesce("_good", F.lit(False))
    attempts = (F.col("attempts") + F.coalesce("_errors", F.lit(0))).cast(pages.schema["attempts"].dataType)
    status = (
        F.when(good, F.col("new_status"))
        .when(hit & bad & (attempts >= MAX_ATTEMPTS), F.lit("failed")).otherwise(F.col("status"))
    )
    changed = {
        "status": status,
        "attempts": attempts,
        "fetch_error": F.when(hit & bad, F.col("error")).otherwise(F.col("fetch_error")),
        "html_path": F.when(good, F.col("new_path")).otherwise(F.col("html_path")),
        "fetched_at": F.when(good, F.lit(now).cast("timestamp")).otherwise(F.col("fetched_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in pages.columns])


def site_circuit_breaker(pages: DataFrame, window: int = 20, threshold: float = 0.4) -> DataFrame:
    """Per site: rows in the window, blocked ones, and whether the site is paused.

    row_number up to a constant prunes rows in each task before the shuffle, so a
    site with most of the rows still sends at most ``window`` rows a task.
    """
    ranked = pages.where("status <> 'pending'").withColumn("_rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("id")))).where(F.col("_rank") <= window)
    counted = ranked.groupBy("site").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "blocked", 1).otherwise(0)).alias("blocked"))
    return counted.select("site", "n", "blocked", ((F.col("n") >= window) & (F.col("blocked") / F.col("n") > threshold)).alias("paused"))


def drop_paused(queue: DataFrame, breaker: DataFrame, force_site: str | None = None) -> DataFrame:
    paused = breaker.where("paused").select("site")
    if force_site is not None:
        paused = paused.where(F.col("site") != force_site)
    return queue.join(paused, "site", "left_anti")


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last update by ``order``, else the existing row.

    Both meet in one window, so the updates are computed once.  Rows of ``existing`` without a key stay; of
    updates without one the last is added.  A table at rest is merged bucket by bucket (``stored.KeyedTable``).
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    ranked = both.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), *order)))
    return ranked.where((F.col("_rank") == 1) | (F.col(key).isNull() & (F.col("_new") == 0))).drop("_new", "_rank")


def _selected(table: str, rows: DataFrame, pages: DataFrame, site: str | None, except_version: str | None, older_than) -> DataFrame:
    """rows with a column _hit: whether every given filter holds; a comparison with null does not."""
    if table not in EVAL_TABLES:
        raise ValueError(f"unknown eval table: {table!r}")
    hit = F.lit(True)
    if except_version is not None:
        hit = hit & F.coalesce(F.col(EVAL_TABLES[table]) != except_version, F.lit(False))
    if older_than is not None:
        hit = hit & F.coalesce(F.col("evaluated_at") < F.lit(older_than).cast("timestamp"), F.lit(False))
    if site is None:
        return rows.withColumn("_hit", hit)
    own = pages.where(F.col("site") == site).select(F.col("id").alias("_site_page"))
    return rows.join(own, rows["page_id"] == own["_site_page"], "left").withColumn("_hit", hit & F.col("_site_page").isNotNull()).drop("_site_page")


def count_eval_rows(table: str, rows: DataFrame, pages: DataFrame, site: str | None = None, except_version: str | None = None, older_than=None) -> DataFrame:
    return _selected(table, rows, pages, site, except_version, older_than).where("_hit").agg(F.count("*").alias("n"))


def clear_eval_rows(table: str, rows: DataFrame, pages: DataFrame, site: str | None = None, except_version: str | None = None, older_than=None) -> DataFrame:
    """The rows that stay."""
    return _selected(table, rows, pages, site, except_version, older_than).where(~F.col("_hit")).drop("_hit")


def reset_url_labels(pages: DataFrame, runs: DataFrame, site: str | None = None, except_version: str | None = None, older_than=None) -> tuple[DataFrame, DataFrame]:
    """(pages, runs): the filtered label rows go, and their pages' labels become null."""
    marked = _selected("classify_url_runs", runs, pages, site, except_version, older_than)
    gone = marked.where("_hit").select(F.col("page_id").alias("_gone")).distinct()
    out = pages.join(gone, pages["id"] == gone["_gone"], "left").withColumn("content_type", F.when(F.col("_gone").isNull(), F.col("content_type"))).drop("_gone")
    return out, marked.where(~F.col("_hit")).drop("_hit")


def clear_extract_runs(runs: DataFrame, pages: DataFrame, site: str | None = None) -> DataFrame:
    own = pages.where(F.col("content_type").isin(*EXTRACTABLE) & _at(site)).select(F.col("id").alias("page_id"))
    return runs.join(own, "page_id", "left_anti")


def flips(runs: DataFrame, run_id: int, before: str, after: str) -> DataFrame:
    """Rows of one run whose value changed; a null new value is an abstention, not a flip."""
    return runs.where((F.col("run_id") == run_id) & F.col(after).isNotNull() & ~F.col(before).eqNullSafe(F.col(after)))


def start_run(runs: DataFrame, run_id: int, stage: str, now, site: str | None = None, args: str | None = None) -> DataFrame:
    row = runs.sparkSession.range(1).select(
        F.lit(run_id).cast("long").alias("id"), F.lit(stage).alias("stage"), F.lit(now).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(site).cast("string").alias("site"), F.lit(args).cast("string").alias("args"), F.lit(None).cast("string").alias("summary"),
    )
    return runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: int, now, summary: str | None = None) -> DataFrame:
    own = F.col("id") == run_id
    return runs.withColumn("finished_at", F.when(own, F.lit(now).cast("timestamp")).otherwise(F.col("finished_at"))).withColumn(
        "summary", F.when(own, F.lit(summary).cast("string")).otherwise(F.col("summary"))
    )
