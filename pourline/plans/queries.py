"""Registered queries over the given tables, each with the SQL that states it.

``QUERIES`` and ``ORACLES`` are filled in pairs by ``query``; an adapter in braces in
the SQL stands for its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, extraction, labels, reports, scoring, search, state, taxonomy, validation
from ..functions import normalize
from ..functions.page_facts import page_facts
from . import adapters as A
from .adapters import adapted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"

_ADAPTERS = {
    "{frontier}": A.FRONTIER, "{batches}": A.URL_BATCHES, "{evals}": A.EVAL_ROWS, "{extracts}": A.EXTRACT_RUNS, "{log}": A.FETCH_LOG,
    "{recipes}": A.RECIPE_PAGES, "{crawl}": A.CRAWL_PAGES, "{tax}": A.TAX_EDGES,
}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            out = sql
            for mark, adapter in _ADAPTERS.items():
                out = out.replace(mark, f"({A.text(adapter, 'duckdb')})")
            ORACLES[name] = out
        return f

    return keep


def frontier(spark: SparkSession, d: str) -> DataFrame:
    return adapted(spark, d, A.FRONTIER)


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return adapted(spark, d, A.EVAL_ROWS)


def recipe_pages(spark: SparkSession, d: str) -> DataFrame:
    return adapted(spark, d, A.RECIPE_PAGES)


def with_facts(spark: SparkSession, d: str) -> DataFrame:
    return recipe_pages(spark, d).withColumn("facts", page_facts(F.col("html"))).drop("html")


# The latest evaluation of each page, by a total order over all columns.
_ORDER = ("evaluated_at", "price", "part", "supp", "qty", "disc", "tax", "run_id", "validator_version", "status")
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY evaluated_at DESC, price DESC, part DESC, supp DESC, qty DESC, disc DESC, tax DESC, run_id DESC, validator_version DESC, status DESC) AS rn FROM {evals}) WHERE rn = 1"


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = eval_rows(spark, d)
    return state.upsert_latest(rows.limit(0), rows, "page_id", [F.desc(c) for c in _ORDER])


def extract_runs(spark: SparkSession, d: str) -> DataFrame:
    return adapted(spark, d, A.EXTRACT_RUNS)


def stored_recipes(spark: SparkSession, d: str) -> DataFrame:
    return frontier(spark, d).where("id % 8 = 1").select(F.col("url").alias("source_url"))


# ---- frontier ----


@query(
    "q1_add_urls",
    """WITH f AS (SELECT url, site, sitemap_source, o1, o2, o3, o4, o5, o6, o7, o8, row_number() OVER (PARTITION BY url ORDER BY o1, o2, o3, o4, o5, o6, o7, o8, site, sitemap_source) AS rn FROM {batches}),
    n AS (SELECT * FROM f WHERE rn = 1 AND url NOT IN (SELECT url FROM {batches} WHERE regexp_matches(url, '[05]$')))
    SELECT (SELECT max(id) FROM {frontier}) + row_number() OVER (ORDER BY o1, o2, o3, o4, o5, o6, o7, o8, url) AS id, site, url, 'pending' AS status, CAST(NULL AS VARCHAR) AS content_type,
    sitemap_source, 0 AS attempts, TIMESTAMP '2024-06-01 00:00:00' AS discovered_at FROM n""",
)
def q1(spark, d):
    batch = adapted(spark, d, A.URL_BATCHES)
    known = batch.where(F.col("url").rlike("[05]$")).select("url").distinct()
    pages = frontier(spark, d).select("id", "url").unionByName(known.select(F.lit(0).cast("long").alias("id"), "url"))
    return state.add_urls(pages, batch, [f"o{k}" for k in range(1, 9)], NOW)


@query(
    "q1_new_urls_by_site",
    """WITH f AS (SELECT url, site, row_number() OVER (PARTITION BY url ORDER BY o1, o2, o3, o4, o5, o6, o7, o8, site, sitemap_source) AS rn FROM {batches})
    SELECT site, count(*) AS n_new FROM f WHERE rn = 1 AND url NOT IN (SELECT url FROM {batches} WHERE regexp_matches(url, '[05]$')) GROUP BY site""",
)
def q1_counts(spark, d):
    return state.new_by_site(q1(spark, d))


@query("q2_pending_queue", "SELECT id, site, url, discovered_at FROM {frontier} WHERE status = 'pending' AND disabled_reason IS NULL AND content_type = 'likely_drink_recipe' ORDER BY site, discovered_at, id LIMIT 500")
def q2(spark, d):
    return state.pending_queue(frontier(spark, d), limit=500, content_type="likely_drink_recipe").select("id", "site", "url", "discovered_at")


@query("q3_unclassified_queue", "SELECT id, site, url, (SELECT count(*) FROM {frontier} WHERE content_type IS NULL AND site = 'diffordsguide') AS n FROM {frontier} WHERE content_type IS NULL AND site = 'diffordsguide' ORDER BY id LIMIT 300")
def q3(spark, d):
    f = frontier(spark, d)
    return state.unclassified_queue(f, "diffordsguide", 300).select("id", "site", "url").join(F.broadcast(state.count_unclassified(f, "diffordsguide")))


@query("q4_pages_by_content_type", "SELECT id, site, url FROM {frontier} WHERE content_type = 'confirmed_drink' AND site = 'imbibe'")
def q4(spark, d):
    return state.pages_by_content_type(frontier(spark, d), "confirmed_drink", "imbibe").select("id", "site", "url")


@query(
    "q5_validate_queue",
    f"""SELECT p.id, p.site, p.url, p.status, p.content_type, p.html_path FROM {{frontier}} p LEFT JOIN (SELECT page_id FROM ({_LATEST}) WHERE page_id % 5 <> 0) v ON v.page_id = p.id
    LEFT JOIN (SELECT page_id FROM ({_LATEST}) WHERE page_id % 7 <> 0) r ON r.page_id = p.id WHERE p.html_path IS NOT NULL AND (v.page_id IS NULL OR r.page_id IS NULL)""",
)
def q5(spark, d):
    runs = latest_runs(spark, d)
    return state.validate_queue(frontier(spark, d), runs.where("page_id % 5 <> 0"), runs.where("page_id % 7 <> 0"))


@query(
    "q6_extract_queue",
    """SELECT p.id, p.site, p.url, p.content_type, p.html_path FROM {frontier} p WHERE content_type IN ('likely_drink_recipe', 'confirmed_drink') AND html_path IS NOT NULL
    AND id NOT IN (SELECT page_id FROM {extracts} WHERE outcome <> 'extracted') AND id % 8 <> 1""",
)
def q6(spark, d):
    return state.extract_queue(frontier(spark, d), extract_runs(spark, d), stored_recipes(spark, d))


_UPDATES = "SELECT id, CASE WHEN id % 2 = 0 THEN 'confirmed_drink' ELSE 'likely_junk' END AS new_type FROM {frontier} WHERE id % 10 < 4"


def _updated(spark, d):
    f = frontier(spark, d)
    updates = f.where("id % 10 < 4").select("id", F.when(F.col("id") % 2 == 0, "confirmed_drink").otherwise("likely_junk").alias("new_type"))
    return state.set_content_type(f, extract_runs(spark, d), updates)


@query(
    "q7_set_content_type_by_url",
    """WITH u AS (SELECT url, max(new_type) AS new_type FROM (SELECT url, CASE WHEN id % 2 = 0 THEN 'confirmed_drink' ELSE 'likely_junk' END AS new_type FROM {frontier} WHERE id % 10 < 4
    UNION ALL SELECT url, 'likely_food_recipe' FROM {frontier} WHERE id % 15 = 0 UNION ALL SELECT url || '/unknown', 'likely_junk' FROM {frontier} WHERE id % 15 = 0) GROUP BY url)
    SELECT f.id, CASE WHEN u.url IS NOT NULL THEN u.new_type ELSE f.content_type END AS content_type FROM {frontier} f LEFT JOIN u USING (url)""",
)
def q7_urls(spark, d):
    f = frontier(spark, d)
    first = f.where("id % 10 < 4").select("url", F.when(F.col("id") % 2 == 0, "confirmed_drink").otherwise("likely_junk").alias("new_type"))
    again = f.where("id % 15 = 0")
    updates = first.unionByName(again.select("url", F.lit("likely_food_recipe").alias("new_type")))
    updates = updates.unionByName(again.select(F.concat("url", F.lit("/unknown")).alias("url"), F.lit("likely_junk").alias("new_type")))
    return state.set_content_type_by_url(f, extract_runs(spark, d), updates)[0].select("id", "content_type")


@query("q7_set_content_type", f"SELECT f.id, CASE WHEN u.id IS NOT NULL THEN u.new_type ELSE f.content_type END AS content_type FROM {{frontier}} f LEFT JOIN ({_UPDATES}) u USING (id)")
def q7(spark, d):
    return _updated(spark, d)[0].select("id", "content_type")


@query("q7_purged_extract_runs", f"SELECT page_id, outcome FROM {{extracts}} WHERE NOT (outcome <> 'extracted' AND page_id IN (SELECT id FROM ({_UPDATES}) WHERE new_type = 'confirmed_drink'))")
def q7b(spark, d):
    return _updated(spark, d)[1].select("page_id", "outcome")


@query(
    "q8_apply_fetch_results",
    """SELECT id, CASE WHEN id % 4 = 0 AND attempts + 1 >= 3 THEN 'failed' WHEN id % 4 = 1 THEN 'Article' ELSE status END AS status, attempts + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS attempts,
    CASE WHEN id % 4 = 0 THEN 'timeout' END AS fetch_error, CASE WHEN id % 4 = 1 THEN concat(site, '/', substr(sha256(url), 1, 16), '.html') ELSE html_path END AS html_path,
    CASE WHEN id % 4 = 1 THEN TIMESTAMP '2024-06-01 00:00:00' END AS fetched_at FROM (SELECT *  REPLACE (CASE WHEN id % 3 = 1 THEN 2 ELSE attempts END AS attempts) FROM {frontier})""",
)
def q8(spark, d):
    f = frontier(spark, d).withColumn("attempts", F.when(F.col("id") % 3 == 1, 2).otherwise(F.col("attempts")))
    path = validation.html_path(F.col("site"), F.col("url"))
    good = f.where("id % 4 = 1").select("url", F.lit(None).cast("string").alias("error"), F.lit("Article").alias("new_status"), path.alias("new_path"))
    bad = f.where("id % 4 = 0").select("url", F.lit("timeout").alias("error"), F.lit(None).cast("string").alias("new_status"), F.lit(None).cast("string").alias("new_path"))
    return state.apply_fetch_results(f, good.unionByName(bad), NOW).select("id", "status", "attempts", "fetch_error", "html_path", "fetched_at")


_BREAKER = """SELECT site, count(*) AS n, CAST(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, count(*) >= 20 AND sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) / count(*) > 0.4 AS paused
    FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY id DESC) AS rn FROM {log} WHERE status <> 'pending') WHERE rn <= 20 GROUP BY site"""


@query("q10_site_circuit_breaker", _BREAKER)
def q10(spark, d):
    return state.site_circuit_breaker(adapted(spark, d, A.FETCH_LOG))


@query("q11_drop_paused", f"SELECT id, site FROM {{log}} WHERE status = 'pending' AND (site = '1' OR site NOT IN (SELECT site FROM ({_BREAKER}) WHERE paused))")
def q11(spark, d):
    log = adapted(spark, d, A.FETCH_LOG)
    return state.drop_paused(log.where("status = 'pending'"), state.site_circuit_breaker(log), "1").select("id", "site")


# ---- evaluation state ----


@query("u1_upsert_latest", f"SELECT page_id, run_id, validator_version, evaluated_at, status FROM ({_LATEST})")
def u1(spark, d):
    return latest_runs(spark, d).select("page_id", "run_id", "validator_version", "evaluated_at", "status")


_CLEARED = f"SELECT r.* FROM ({_LATEST}) r WHERE NOT (validator_version <> 'A' AND evaluated_at < TIMESTAMP '1999-01-01' AND page_id IN (SELECT id FROM {{frontier}} WHERE site = 'diffordsguide'))"


@query("u2_clear_eval_rows", f"SELECT page_id, validator_version, (SELECT count(*) FROM ({_LATEST})) - (SELECT count(*) FROM ({_CLEARED})) AS n_cleared FROM ({_CLEARED})")
def u2(spark, d):
    given = ("validate_html_runs", latest_runs(spark, d), frontier(spark, d), "diffordsguide", "A", "1999-01-01")
    return state.clear_eval_rows(*given).select("page_id", "validator_version").join(F.broadcast(state.count_eval_rows(*given).select(F.col("n").alias("n_cleared"))))


@query("u3_reset_url_labels", f"SELECT id, CASE WHEN id IN (SELECT page_id FROM ({_LATEST}) WHERE validator_version <> 'N') THEN NULL ELSE content_type END AS content_type FROM {{frontier}}")
def u3(spark, d):
    runs = latest_runs(spark, d).withColumnRenamed("validator_version", "prompt_version")
    return state.reset_url_labels(frontier(spark, d), runs, except_version="N")[0].select("id", "content_type")


@query("u4_clear_extract_runs", "SELECT page_id, outcome FROM {extracts} WHERE page_id NOT IN (SELECT id FROM {frontier} WHERE content_type IN ('likely_drink_recipe', 'confirmed_drink') AND site = 'diffordsguide')")
def u4(spark, d):
    return state.clear_extract_runs(extract_runs(spark, d), frontier(spark, d), "diffordsguide")


@query("u5_flips", f"SELECT page_id, pages_status_before, status FROM ({_LATEST}) WHERE run_id = 3 AND status IS NOT NULL AND status IS DISTINCT FROM pages_status_before")
def u5(spark, d):
    return state.flips(latest_runs(spark, d), 3, "pages_status_before", "status").select("page_id", "pages_status_before", "status")


@query("u6_run_ledger", "SELECT CAST(site_no AS BIGINT) AS id, 'validate' AS stage, CASE WHEN site_no = 1 THEN '{\"n\": 1}' END AS summary, n FROM (SELECT 1 AS site_no UNION ALL SELECT 2) a, (SELECT count(*) AS n FROM {frontier}) b")
def u6(spark, d):
    none = spark.createDataFrame([], "id long, stage string, started_at timestamp, finished_at timestamp, site string, args string, summary string")
    runs = state.start_run(state.start_run(none, 1, "validate", NOW), 2, "validate", NOW)
    n = frontier(spark, d).agg(F.count("*").alias("n"))
    return state.finish_run(runs, 1, NOW, '{"n": 1}').select("id", "stage", "summary").join(F.broadcast(n))


@query("u6_runs_of_orders", """SELECT o_orderkey AS id, 'fetch' AS stage, o_orderkey = 32 AS finished, CASE WHEN o_orderkey = 32 THEN '{"n": 2}' END AS summary FROM orders
    UNION ALL SELECT -1, 'validate', true, '{"n": 1}' UNION ALL SELECT -2, 'label', false, NULL""")
def u6_orders(spark, d):
    """A ledger with a run for each order, to which two runs are added and in which two are finished."""
    A.register(spark, d)
    runs = spark.table("orders").select(
        F.col("o_orderkey").alias("id"), F.lit("fetch").alias("stage"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("string").alias("site"), F.lit(None).cast("string").alias("args"), F.lit(None).cast("string").alias("summary"),
    )
    runs = state.start_run(state.start_run(runs, -1, "validate", NOW), -2, "label", NOW)
    runs = state.finish_run(state.finish_run(runs, -1, NOW, '{"n": 1}'), 32, NOW, '{"n": 2}')
    return runs.select("id", "stage", F.col("finished_at").isNotNull().alias("finished"), "summary")


# ---- labels ----


@query("l1_label_message", "SELECT id, concat('URL: ', url, chr(10), 'Sitemap: ', CASE WHEN coalesce(sitemap_source, '') = '' THEN '(none)' ELSE sitemap_source END) AS message FROM {frontier}")
def l1(spark, d):
    return frontier(spark, d).select("id", labels.label_message_col(F.col("url"), F.col("sitemap_source")).alias("message"))


_RAW = "CASE WHEN id % 4 = 0 THEN concat('{\"label\": \"', coalesce(content_type, 'x'), '\"}') WHEN id % 4 = 1 THEN '{\"label\": \"likely_junk\", \"why\": [1, 2]}' WHEN id % 4 = 2 THEN '{\"label\": ' ELSE '[\"likely_junk\"]' END"
_LABELS = ", ".join(f"'{x}'" for x in labels.LABELS)


@query("l2_parse_label_response", f"SELECT id, CASE WHEN j->>'$.label' IN ({_LABELS}) THEN j->>'$.label' END AS label FROM (SELECT id, TRY_CAST({_RAW} AS JSON) AS j FROM {{frontier}})")
def l2(spark, d):
    return frontier(spark, d).select("id", labels.parse_label_response(F.expr(_RAW)).alias("label"))


def _fake_labeller(message: str) -> str:
    """Deterministic: recipes by path, junk for videos, an unknown label for stories."""
    return '{"label": "likely_junk"}' if "/videos/" in message else '{"label": "nonsense"}' if "/story/" in message else '{"label": "likely_drink_recipe"}'


@query("l3_label_urls", "SELECT id, CASE WHEN content_type IS NOT NULL THEN content_type WHEN contains(url, '/videos/') THEN 'likely_junk' WHEN contains(url, '/story/') THEN NULL ELSE 'likely_drink_recipe' END AS content_type FROM {frontier}")
def l3(spark, d):
    none = spark.createDataFrame([], "page_id long, run_id long, label string, model string, prompt_version string, raw_response string, latency_ms long, evaluated_at timestamp, pages_content_type_before string")
    return labels.label_urls(frontier(spark, d), none, extract_runs(spark, d), _fake_labeller, "fake", "v1", 1, NOW)[0].select("id", "content_type")


@query("l4_label_counts", "SELECT site, coalesce(content_type, 'classify_error') AS label, count(*) AS n FROM {frontier} WHERE id % 3 = 1 GROUP BY ALL")
def l4(spark, d):
    f = frontier(spark, d)
    return labels.label_counts(f, f.where("id % 3 = 1"))


_ADJ = " OR ".join(f"url ILIKE '%/encyclopedia/%/{s}/%'" for s in "bars books bws cocktails events people productsandservices simons-blog".split())
_R = f"""SELECT *, CASE WHEN site = 'diffordsguide' AND (url ILIKE '%/encyclopedia/%/company-info/%' OR url ILIKE '%/encyclopedia/%/competitions/%') THEN 'likely_junk'
    WHEN site = 'diffordsguide' AND ({_ADJ}) THEN 'likely_cocktail_adjacent' WHEN site = 'foodnetwork' AND url ILIKE '%/videos/%' THEN 'likely_junk' WHEN site = 'imbibe' AND url ILIKE '%/drink-of-the-week-%' THEN 'likely_drink_article'
    WHEN site = 'foodnetwork' AND url ILIKE '%/recipes/articles/%' AND content_type = 'likely_food_recipe' THEN 'likely_food_article' WHEN site = 'foodnetwork' AND url ILIKE '%/recipes/articles/%' AND content_type = 'likely_drink_recipe' THEN 'likely_drink_article'
    WHEN site = 'bonappetit' AND url ILIKE '%/story/%' AND content_type = 'likely_drink_recipe' THEN 'likely_unstructured_drink_recipe' ELSE content_type END AS new_type FROM {{frontier}}"""


@query("l5_reclassify", f"SELECT id, new_type FROM ({_R}) WHERE new_type IS DISTINCT FROM content_type")
def l5(spark, d):
    return labels.audit_rows(labels.reclassify(frontier(spark, d)), NOW).select(F.col("page_id").alias("id"), F.col("label").alias("new_type"))


@query("l5_rule_counts", f"SELECT concat(site, ':', new_type) AS rule, count(*) AS n FROM ({_R}) WHERE new_type IS DISTINCT FROM content_type GROUP BY 1")
def l5b(spark, d):
    out = labels.reclassify(frontier(spark, d), dry_run=True)
    by_key = {r.key: f"{r.key.split('_')[0]}:{r.label}" for r in labels.default_rules()}
    names = F.create_map(*[F.lit(x) for kv in by_key.items() for x in kv])
    return labels.rule_counts(out).select(names[F.col("key")].alias("rule"), "n")


@query("l6_null_labels", "SELECT id, CASE WHEN coalesce(sitemap_source = 'sitemap-1.xml', false) THEN NULL ELSE content_type END AS content_type FROM {frontier}")
def l6(spark, d):
    return labels.null_labels(frontier(spark, d), [labels.sitemap_rule("ugc", "sitemap-1.xml", "likely_user_generated")]).select("id", "content_type")


@query("l7_sample_labels", f"SELECT page_id, site, url, status FROM ({_LATEST}) r JOIN (SELECT id, site, url FROM {{frontier}}) f ON f.id = r.page_id WHERE site = 'imbibe' ORDER BY md5(concat(CAST(page_id AS VARCHAR), 'seed7')), page_id LIMIT 25")
def l7(spark, d):
    return labels.sample_labels(latest_runs(spark, d), frontier(spark, d), 25, "seed7", site="imbibe").select("page_id", "site", "url", "status")


@query("l8_lookup_labels", f"SELECT a.pos, a.url, f.id, r.status AS label FROM (SELECT id AS pos, CASE WHEN id % 5 = 0 THEN 'https://unknown/' ELSE url END AS url FROM {{frontier}}) a LEFT JOIN {{frontier}} f ON f.url = a.url LEFT JOIN ({_LATEST}) r ON r.page_id = f.id")
def l8(spark, d):
    f = frontier(spark, d)
    asked = f.select(F.col("id").alias("pos"), F.when(F.col("id") % 5 == 0, "https://unknown/").otherwise(F.col("url")).alias("url"))
    return labels.lookup_labels(asked, f, latest_runs(spark, d).withColumn("label", F.col("status")))


@query("l9_review_labels", "SELECT count(*) AS total, CAST(sum(CASE WHEN quality = (CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS BIGINT) AS correct, 100.0 * sum(CASE WHEN quality = (CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) / count(*) AS pct FROM labels JOIN documents USING (doc_id)")
def l9(spark, d):
    A.register(spark, d)
    expected = spark.table("labels").select("doc_id", F.col("quality").cast("string").alias("expected"))
    predicted = spark.table("documents").select("doc_id", F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("predicted"))
    return labels.review_labels(expected, predicted, "doc_id")[0]


# ---- reports ----


@query("a1_site_status_stats", "SELECT site, status, count(*) AS n FROM {frontier} GROUP BY ALL")
def a1(spark, d):
    return reports.site_status_stats(frontier(spark, d))


@query("a2_run_summary", "SELECT site, status AS category, count(*) AS n FROM {frontier} GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*) FROM {frontier}")
def a2(spark, d):
    return reports.run_summary(frontier(spark, d).select("site", F.col("status").alias("category")))


@query("a3_fetch_summary", f"SELECT status AS outcome, count(*) AS n FROM {{log}} GROUP BY 1 UNION ALL SELECT concat('paused:', site), 1 FROM ({_BREAKER}) WHERE paused")
def a3(spark, d):
    log = adapted(spark, d, A.FETCH_LOG)
    return reports.fetch_summary(log.withColumn("error", F.lit(None).cast("string")), state.site_circuit_breaker(log))


# ---- taxonomy ----

_CLOSURE = "WITH RECURSIVE c AS (SELECT parent_id AS ancestor, child_id AS descendant, 1 AS depth FROM {tax} UNION SELECT c.ancestor, e.child_id, c.depth + 1 FROM c JOIN {tax} e ON e.parent_id = c.descendant) SELECT ancestor, descendant, min(depth) AS depth FROM c GROUP BY ALL"


@query("t3_taxonomy_closure", _CLOSURE)
def t3(spark, d):
    return taxonomy.taxonomy_closure(adapted(spark, d, A.TAX_EDGES))


@query("t4_find_cycles", "SELECT parent_id AS node_id, 2 AS depth FROM {tax} WHERE child_id = 3 UNION SELECT 3, 2")
def t4(spark, d):
    edges = adapted(spark, d, A.TAX_EDGES)
    back = edges.where("child_id = 3").select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    return taxonomy.find_cycles(taxonomy.taxonomy_closure(edges.unionByName(back)))


@query("t1_t2_build_and_resolve", "SELECT n_nationkey AS row_id, n_nationkey AS node_id FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 0")
def t1(spark, d):
    A.register(spark, d)
    nation = spark.table("nation")
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("slug"), F.lit(None).cast("string").alias("role"))
    pairs = nation.where("n_nationkey % 5 <> 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("alias"), F.col("n_name").alias("slug"))
    _, aliases = taxonomy.build_taxonomy(nodes, spark.createDataFrame([], "parent string, child string"), pairs)
    texts = nation.select(F.col("n_nationkey").alias("row_id"), F.concat("n_name", F.lit("  ")).alias("text"))
    return taxonomy.resolve_aliases(texts, aliases).select("row_id", "node_id")


_PART_EDGES = "(SELECT CAST(p_partkey // 10 AS BIGINT) AS parent_id, CAST(p_partkey AS BIGINT) AS child_id FROM part WHERE p_partkey > 0 AND p_partkey // 10 IN (SELECT p_partkey FROM part))"


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a tree: the parent of a part has its key without the last digit; pairs of parts that do not exist drop out."""
    A.register(spark, d)
    part = spark.table("part").select(F.col("p_partkey").cast("long").alias("id"))
    slug = lambda key: F.concat(F.lit("part-"), key.cast("string"))
    nodes = part.select("id", slug(F.col("id")).alias("slug"))
    pairs = part.where("id > 0").select(slug(F.floor(F.col("id") / 10).cast("long")).alias("parent"), slug(F.col("id")).alias("child"))
    gone = part.where("id % 7 = 0").select(slug(F.col("id")).alias("parent"), F.lit("gone").alias("child"))
    none = spark.createDataFrame([], "alias string, slug string")
    return taxonomy.build_taxonomy(nodes, pairs.unionByName(gone), none)[0]


@query("t1_edges_of_parts", f"SELECT parent_id, child_id FROM {_PART_EDGES}")
def t1_edges(spark, d):
    return part_edges(spark, d)


@query("t3_closure_of_parts", _CLOSURE.replace("{tax}", _PART_EDGES))
def t3_parts(spark, d):
    return taxonomy.taxonomy_closure(part_edges(spark, d))
