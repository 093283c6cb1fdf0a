"""Page validation: what a fetched page is, or why it is blocked; a projection of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable
from ..functions.page_facts import PRIORITY, page_facts
from .scoring import SCORER_VERSION, classify_pages
from .state import set_content_type, upsert_latest, validate_queue

VALIDATOR_VERSION = "v1"
LEAST_BYTES, LEAST_TEXT = 5000, 500
#: Bytes of queue rows that are sent to every task.
BROADCAST_BYTES = 8 << 20
#: Blocker fingerprints in order, each with its reason.
FINGERPRINTS = (
    ("cf-challenge-running", "cf-challenge detected"),
    ("cf-turnstile", "cf-turnstile detected"),
    ("g-recaptcha", "recaptcha detected"),
    ("hcaptcha", "hcaptcha detected"),
    ("Access Denied", "access denied"),
    ("_pxhd", "perimeterx detected"),
    ("datadome", "datadome detected"),
    ("Enable JavaScript and cookies", "javascript required page"),
    ("Please verify you are a human", "human verification page"),
    ("cf-mitigated", "cf-mitigated detected"),
)
#: Fixed value: the pattern of a canonical link.
CANONICAL = r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"']"


def host(url: Column) -> Column:
    """Lower-cased host with its port, without one leading www.; empty for a relative URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)), r"^www\.", "")


def canonical_mismatch(html: Column, url: Column) -> Column:
    """The canonical URL if it names another host than url, else null."""
    canonical = F.trim(F.regexp_extract(html, CANONICAL, 1))
    other = host(canonical)
    return F.when((F.coalesce(url, F.lit("")) != "") & (other != "") & (other != host(url)), canonical)


def type_rank(name: Column) -> Column:
    out = F.when(name.isNull(), 99)
    for i, known in enumerate(PRIORITY):
        out = out.when(name == known, i)
    return out.otherwise(len(PRIORITY))


def page_type(facts: Column) -> tuple[Column, Column]:
    """(type, reason): the better of JSON-LD and microdata, JSON-LD on ties; null without either.  An empty type is none."""
    a, b = F.nullif(facts["jsonld_type"], F.lit("")), F.nullif(facts["microdata_type"], F.lit(""))
    first = a.isNotNull() & (type_rank(a) <= type_rank(b))
    kind = F.when(first, a).otherwise(b)
    return kind, F.when(first, F.concat(F.lit("JSON-LD @type: "), a)).otherwise(F.concat(F.lit("microdata @type: "), b))


def blocker(html: Column) -> Column:
    """The reason of a page that is too small or holds a fingerprint, the first that applies; else null."""
    out = F.when(F.octet_length(html) < LEAST_BYTES, "Size under 5KB — likely not a content page")
    for mark, reason in FINGERPRINTS:
        out = out.when(html.contains(mark), reason)
    return out


def soft_404(html: Column) -> Column:
    low = F.lower(html)
    title = F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1)
    return low.contains('content="noindex"') | low.contains("content='noindex'") | title.contains("not found") | title.contains("404")


def validate(pages: DataFrame) -> DataFrame:
    """pages(url, html, facts) -> with new_status and reason, by the first check that decides."""
    wrong = canonical_mismatch(F.col("html"), F.col("url"))
    kind, said = page_type(F.col("facts"))
    blocked = F.coalesce(
        blocker(F.col("html")),
        F.when(soft_404(F.col("html")), "Soft 404 detected"),
        F.when(F.col("facts.text_len") < LEAST_TEXT, "Insufficient visible text — likely empty JS shell"),
    )
    out = pages.withColumns({"_wrong": wrong, "_kind": kind, "_said": said, "_blocked": blocked})
    status = F.when(F.col("_wrong").isNotNull(), "blocked").when(F.col("_kind").isNotNull(), F.col("_kind")).when(F.col("_blocked").isNotNull(), "blocked").otherwise("unverified")
    reason = F.coalesce(F.concat(F.lit("canonical host mismatch: "), F.col("_wrong")), F.col("_said"), F.col("_blocked"), F.lit("No structured data found"))
    return out.withColumns({"new_status": status, "reason": reason}).drop("_wrong", "_kind", "_said", "_blocked")


def evaluate(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> new_status, reason, score, rules, label; each page is parsed once and its html dropped."""
    return classify_pages(validate(pages.withColumn("facts", page_facts(F.col("html"))))).drop("html")


def join_html_cache(rows: DataFrame, cache: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with html by html_path; rows without a cached page keep a null html.

    No page is shuffled.  The rows, narrow as they are, are written and counted; while they take at most
    ``broadcast_bytes`` they go to every task that scans the cache, and rows without a page are found over its path column.
    Beyond it they are dealt as the cache is, which for a table of ``write_bucketed_cache`` moves the rows
    alone; a cache without buckets is dealt too.
    """
    rows = durable(rows)
    pages = cache.select(F.col("html_path").alias("_path"), "html")
    on = F.col("html_path") == F.col("_path")
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in rows.schema), F.lit(0)))).first()[0] or 0
    if size > broadcast_bytes:
        return rows.join(pages, on, "left").drop("_path")
    found = pages.join(F.broadcast(rows), on).select(*rows.columns, "html")
    without = rows.join(cache.select(F.col("html_path").alias("_path")), on, "left_anti").withColumn("html", F.lit(None).cast("string"))
    return found.unionByName(without)


def transitions(evaluated: DataFrame) -> DataFrame:
    """Counts per site of what changed: status, and label unless blocked or without one."""
    change = lambda old, new: F.concat(F.coalesce(old, F.lit("NULL")), F.lit(" -> "), new)
    status = F.when(~F.col("status").eqNullSafe(F.col("new_status")), change(F.col("status"), F.col("new_status")))
    label = F.when(
        (F.col("new_status") != "blocked") & F.col("label").isNotNull() & ~F.col("content_type").eqNullSafe(F.col("label")),
        change(F.col("content_type"), F.col("label")),
    )
    return (
        evaluated.select("site", F.explode(F.array(status, label)).alias("transition")).where("transition IS NOT NULL")
        .groupBy("site", "transition").agg(F.count("*").alias("n"))
    )


def eval_rows(evaluated: DataFrame, run_id: int, now) -> tuple[DataFrame, DataFrame]:
    """(validate_html_runs, classify_drink_runs) rows with snapshots from before the run."""
    common = [F.col("id").alias("page_id"), F.lit(run_id).cast("long").alias("run_id")]
    at = F.lit(now).cast("timestamp").alias("evaluated_at")
    return (
        evaluated.select(*common, F.col("new_status").alias("status"), "reason", F.lit(VALIDATOR_VERSION).alias("validator_version"), at, F.col("status").alias("pages_status_before")),
        evaluated.select(*common, "label", "score", F.to_json(F.struct("rules")).alias("score_detail"), F.lit(SCORER_VERSION).alias("scorer_version"), at, F.col("content_type").alias("pages_content_type_before")),
    )


def revalidate(
    pages: DataFrame, cache: DataFrame, validate_runs: DataFrame, drink_runs: DataFrame, extract_runs: DataFrame,
    run_id: int, now, site: str | None = None, limit: int | None = None, dry_run: bool = False,
) -> dict[str, DataFrame]:
    """Validate and score the queue again: new tables, transition counts and the number of missing files.

    A page that becomes blocked loses its html_path; one whose status stays is not
    touched; a new label goes through set_content_type.  dry_run leaves all tables.
    """
    joined = join_html_cache(validate_queue(pages, validate_runs, drink_runs, site, limit), cache)
    missing = joined.where("html IS NULL").agg(F.count("*").alias("missing"))
    evaluated = durable(evaluate(joined.where("html IS NOT NULL")))  # four results read it; pages are parsed once
    out = {"transitions": transitions(evaluated), "missing": missing, "evaluated": evaluated}
    if dry_run:
        return out | {"pages": pages, "validate_html_runs": validate_runs, "classify_drink_runs": drink_runs, "extract_runs": extract_runs}
    new_validate, new_drink = eval_rows(evaluated, run_id, now)
    changed = evaluated.where(~F.col("status").eqNullSafe(F.col("new_status"))).select(F.col("id").alias("_id"), "new_status")
    hit = F.col("_id").isNotNull()
    moved = (
        pages.join(changed, pages["id"] == changed["_id"], "left")
        .withColumn("html_path", F.when(~(hit & (F.col("new_status") == "blocked")), F.col("html_path")))
        .withColumn("fetched_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("fetched_at")))
        .withColumn("status", F.when(hit, F.col("new_status")).otherwise(F.col("status")))
        .select(*pages.columns)
    )
    relabel = evaluated.where((F.col("new_status") != "blocked") & F.col("label").isNotNull() & ~F.col("content_type").eqNullSafe(F.col("label")))
    new_pages, new_extract = set_content_type(moved, extract_runs, relabel.select("id", F.col("label").alias("new_type")))
    return out | {
        "pages": new_pages, "extract_runs": new_extract,
        "validate_html_runs": upsert_latest(validate_runs, new_validate, "page_id", [F.col("page_id")]),
        "classify_drink_runs": upsert_latest(drink_runs, new_drink, "page_id", [F.col("page_id")]),
    }


def fetch_ingest(pages: DataFrame, results: DataFrame, run_id: int, now) -> dict[str, DataFrame]:
    """results(url, html, error) of fetched pages: attempts and statuses, both evaluations, and labels unless blocked or without one."""
    from .state import apply_fetch_results

    known = pages.select("id", "site", "url", "status", "content_type")
    evaluated = durable(evaluate(results.where("error IS NULL AND html IS NOT NULL").select("url", "html").join(known, "url")))
    path = html_path(F.col("site"), F.col("url"))
    good = evaluated.select("url", F.lit(None).cast("string").alias("error"), "new_status", path.alias("new_path"))
    bad = results.where("error IS NOT NULL").select("url", "error", F.lit(None).cast("string").alias("new_status"), F.lit(None).cast("string").alias("new_path"))
    moved = apply_fetch_results(pages, good.unionByName(bad), now)
    relabel = evaluated.where((F.col("new_status") != "blocked") & F.col("label").isNotNull()).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    labelled = moved.join(relabel, moved["id"] == relabel["_id"], "left").withColumn("content_type", F.coalesce("_label", "content_type")).select(*pages.columns)
    new_validate, new_drink = eval_rows(evaluated, run_id, now)
    return {"pages": labelled, "validate_html_runs": new_validate, "classify_drink_runs": new_drink, "evaluated": evaluated}


def html_path(site: Column, url: Column) -> Column:
    """Where a page is cached: site / first 16 hex digits of the url's SHA-256 .html"""
    return F.concat(site, F.lit("/"), F.substring(F.sha2(url, 256), 1, 16), F.lit(".html"))
