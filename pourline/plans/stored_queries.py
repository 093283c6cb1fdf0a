"""Registered queries over tables at rest: merges, a bucketed cache, a search index, page directories; and over graphs and sets that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.page_facts import page_facts
from ..operators import dedup, labels, search, taxonomy
from ..operators.scoring import classify_pages
from ..operators.structured import jsonld_nodes
from ..operators.search_index import SearchIndex
from ..operators.stored import KeyedTable, merge_recipes
from ..operators.validation import html_path, join_html_cache, validate
from ..shared import new_folder
from ..sources.files import expand_sitemap_index, write_bucketed_cache
from ..streaming import jobs
from ..streaming.frontier import UrlFrontier, discover_to
from . import adapters as A
from .adapters import adapted
from .recipe_queries import _NODES
from .queries import NOW, ORACLES, QUERIES, eval_rows, extract_runs, frontier, query, recipe_pages

__all__ = ["ORACLES", "QUERIES"]

CUT_LOG = "(SELECT id, site, status, CAST(floor(id * 3 / (1 + (SELECT max(id) FROM {log}))) AS INT) AS part FROM {log})"

#: Buckets of the tables below; a table at rest has its size over what a task should rewrite.
BUCKETS = 16
_RUNS = "page_id long, run_id long, validator_version string, evaluated_at timestamp, status string, price double, part long, supp long, qty double, disc double, tax double"
_ORDER = ("evaluated_at", "price", "part", "supp", "qty", "disc", "tax", "run_id", "validator_version", "status")
_NEWEST = ", ".join(f"{c} DESC" for c in _ORDER)


@query("u1_stored_merge", f"""SELECT page_id, run_id, validator_version, evaluated_at, status FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY evaluated_at >= DATE '1995-06-01' DESC, {_NEWEST}) AS rn FROM {{evals}})
    WHERE rn = 1""")
def u1_stored(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations before a day as a stored table, into which all later ones are merged."""
    store = KeyedTable(f"{new_folder(spark, 'runs')}/table", "page_id", _RUNS, BUCKETS)
    rows = eval_rows(spark, d)
    for some in ("evaluated_at < DATE '1995-06-01'", "evaluated_at >= DATE '1995-06-01'"):
        store.merge(rows.where(some), [F.desc(c) for c in _ORDER])
    return store.rows(spark).select("page_id", "run_id", "validator_version", "evaluated_at", "status")


_RECIPES = "id long, source_url string, site string, name string, author string, image_url string, jsonld string, fetched_at timestamp, extracted_at timestamp"


def _as_recipes(rows: DataFrame, name, at: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("id", F.col("url").alias("source_url"), "site", name.alias("name"), none.alias("author"), none.alias("image_url"), F.lit("{}").alias("jsonld"), F.lit(at).cast("timestamp").alias("fetched_at"))


@query("s5_stored_merge", """SELECT CASE WHEN id % 3 <> 0 THEN id END AS known_id, url AS source_url, CASE WHEN id % 4 = 0 THEN concat(status, ' again') ELSE status END AS name,
    CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN TIMESTAMP '2024-06-02 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS extracted_at FROM {frontier}""")
def s5_stored(spark, d):
    """Two thirds of the catalog are stored; then all of it comes again, a quarter with other names: ids stay, and so do rows without a change."""
    store = KeyedTable(f"{new_folder(spark, 'recipes')}/table", "source_url", _RECIPES, BUCKETS)
    pages = frontier(spark, d)
    first = _as_recipes(pages.where("id % 3 <> 0"), F.col("status"), NOW).withColumn("extracted_at", F.lit(NOW).cast("timestamp"))
    store.merge(first, [F.col("id")])
    again = F.when(F.col("id") % 4 == 0, F.concat("status", F.lit(" again"))).otherwise(F.col("status"))
    merge_recipes(store, _as_recipes(pages, again, "2024-06-02 00:00:00").drop("id"), "2024-06-02 00:00:00")
    known = F.when(F.col("id") != F.xxhash64("source_url"), F.col("id")).alias("known_id")
    return store.rows(spark).select(known, "source_url", "name", "extracted_at")


@query("s3_bucketed_cache", "SELECT site, count(*) AS n, CAST(sum(CASE WHEN id % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN id % 10 <> 1 THEN length(html) END) AS BIGINT) AS chars FROM {recipes} GROUP BY site")
def s3_bucketed(spark, d):
    """Cached pages as a bucketed table, joined with a queue that is too large to send to every task (as the bound says)."""
    pages = recipe_pages(spark, d)
    path = html_path(F.col("site"), F.col("url"))
    name = "html_cache_" + new_folder(spark, "x").rpartition("-")[2]
    write_bucketed_cache(pages.where("id % 10 <> 1").select(path.alias("html_path"), "html"), name, BUCKETS)
    joined = join_html_cache(pages.select("site", "url", path.alias("html_path")), spark.table(name), broadcast_bytes=0)
    return joined.groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("html").isNull().cast("long")).alias("missing"), F.sum(F.length("html")).alias("chars"))


# Catalog of the given web pages: the page's url is its name, its source its lines.
_CATALOG = "SELECT page_id AS id, url AS name, substr(html, 1, 300) AS ingredients_json FROM pages"
_TERMS = "concat(substr(name, 9, 6), CASE WHEN id % 200 = 0 THEN ' body' ELSE ' html' END)"


@query("f4_stored_index_search", f"""WITH c AS (SELECT id, CASE WHEN id % 7 = 0 THEN concat(name, ' edited') ELSE name END AS name, ingredients_json FROM ({_CATALOG})),
    q AS (SELECT id AS query_id, lower(regexp_replace(substr(name, 9, 6), '^[^A-Za-z0-9\\\\%_*]+|[^A-Za-z0-9\\\\%_*]+$', '', 'g')) AS t1, CASE WHEN id % 200 = 0 THEN 'edited' ELSE 'html' END AS t2 FROM ({_CATALOG}) WHERE id % 100 = 0)
    SELECT query_id, id FROM q, c WHERE (length(t1) < 3 OR contains(lower(name), t1) OR contains(lower(ingredients_json), t1)) AND (contains(lower(name), t2) OR contains(lower(ingredients_json), t2))""")
def f4_stored(spark, d):
    """Pages in a stored index, a seventh of them replaced afterwards; queries of every page whose id is divisible by 100."""
    A.register(spark, d)
    catalog = spark.sql(_CATALOG)
    index = SearchIndex(new_folder(spark, "index"), BUCKETS, BUCKETS)
    index.upsert(catalog, 1)
    index.upsert(catalog.where("id % 7 = 0").withColumn("name", F.concat("name", F.lit(" edited"))), 2)
    queries = catalog.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.concat(F.substring("name", 9, 6), F.when(F.col("id") % 200 == 0, " edited").otherwise(" html")).alias("q"))
    return index.search(queries)


@query("f3_stored_page", """SELECT id, site, name, image_url, (SELECT count(*) FROM {frontier}) AS total FROM (SELECT id, site, url AS name, html_path AS image_url FROM {frontier})
    ORDER BY name NULLS LAST, id LIMIT 50 OFFSET (SELECT 50 * CAST(floor(count(*) / 100) AS BIGINT) FROM {frontier})""")
def f3_stored(spark, d):
    """The page in the middle of the frontier, from a stored page index."""
    rows = frontier(spark, d).select("id", "site", F.col("url").alias("name"), F.col("html_path").alias("image_url"))
    path = new_folder(spark, "pages")
    search.write_page_index(rows, path, BUCKETS)
    return search.stored_page(spark, path, rows.count() // 100 + 1, 50)


# Orders of a customer by key: each leads to the next, and the last of every third customer back to the one before it or the first.
_NEXT = """SELECT o_orderkey AS parent_id, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 3 = 0 THEN lag(o_orderkey, CAST(1 + o_custkey % 5 AS INT)) OVER w END) AS child_id, o_custkey,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


@query("t4_cyclic_orders", f"""SELECT parent_id AS node_id, min(parent_id) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n_nodes
    FROM ({_NEXT.replace('CAST(1 + o_custkey % 5 AS INT)', '1 + o_custkey % 5')}) WHERE o_custkey % 3 = 0 AND n > 1 + o_custkey % 5 AND k >= n - 1 - o_custkey % 5""")
def t4_orders(spark, d):
    """Nodes on cycles of a graph of all orders: the last orders of a third of the customers go round."""
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    steps = [f"WHEN o_custkey % 5 = {k} THEN lag(o_orderkey, {k + 1}) OVER w" for k in range(5)]
    back = f"CASE WHEN o_custkey % 3 = 0 THEN CASE {' '.join(steps)} END END"
    edges = spark.sql(f"SELECT o_orderkey AS parent_id, coalesce(lead(o_orderkey) OVER w, {back}) AS child_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
    return taxonomy.cyclic_nodes(edges)


_SETS = "SELECT l_orderkey AS id, l_suppkey AS s FROM lineitem GROUP BY ALL"


@query("r2_order_overlap", f"""WITH p AS ({_SETS}), n AS (SELECT id, count(*) AS n FROM p GROUP BY id), c AS (SELECT a.id, b.id AS other_id, count(*) AS c FROM p a JOIN p b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
    j AS (SELECT c.id, other_id, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.id = c.id JOIN n y ON y.id = other_id WHERE 5 * c >= 3 * (x.n + y.n - c))
    SELECT id, other_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, other_id) AS rn FROM j) WHERE rn <= 3""")
def r2_orders(spark, d):
    """Of each order the three others whose sets of suppliers are most alike, at 0.6 or more."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    sets = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("parts"))
    return dedup.most_similar(sets, 3, 0.6)


def _picky_labeller(message: str) -> str:
    """One in ten urls is refused with an error."""
    if message.split("\n")[0].endswith("3"):
        raise ValueError("refused")
    return '{"label": "likely_junk"}'


@query("l3_label_errors", "SELECT id, CASE WHEN url LIKE '%3' THEN 'ValueError: refused' END AS error, CASE WHEN url NOT LIKE '%3' THEN 'likely_junk' END AS label, true AS timed FROM {frontier} WHERE content_type IS NULL")
def l3_errors(spark, d):
    none = spark.createDataFrame([], "page_id long, run_id long, label string, model string, prompt_version string, raw_response string, latency_ms long, evaluated_at timestamp, pages_content_type_before string")
    asked = labels.label_urls(frontier(spark, d), none, extract_runs(spark, d), _picky_labeller, "fake", "v1", 1, NOW)[3]
    return asked.select("id", "error", "label", (F.col("latency_ms") >= 0).alias("timed"))


#: Recipe pages whose structured data is microdata: an untyped page, an empty type, an article or a recipe by id.
MICRO_PAGES = """
SELECT id, site, url, status, content_type, concat('<html><body>', CASE id % 5 WHEN 0 THEN '<script type="application/ld+json">{"@type":""}</script>' ELSE '' END,
  CASE id % 4 WHEN 0 THEN '<p>no item</p>' WHEN 1 THEN '<div itemscope itemtype=""><p itemprop="name">x</p></div>'
    WHEN 2 THEN concat('<div itemscope itemtype="https://schema.org/Article"><h1 itemprop="name">', title, '</h1></div>')
    ELSE concat('<div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name">', title, '</h1><span itemprop="author" itemscope itemtype="http://schema.org/Person"><b itemprop="name">Ann ', site, '</b></span></div>') END,
  repeat('<i>some words of text </i>', 300), '</body></html>') AS html
FROM (SELECT p_partkey AS id, concat('site', CAST(p_partkey % 14 AS STRING)) AS site, concat('https://www.site', CAST(p_partkey % 14 AS STRING), '.com/m/', CAST(p_partkey AS STRING)) AS url,
  'pending' AS status, CAST(NULL AS STRING) AS content_type, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Negroni' WHEN 1 THEN ' Cake' ELSE ' Salad' END) AS title FROM part) t"""


def micro_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages, made of parts that are dealt over all tasks: the table may be one small file, whose pages one task would make and parse."""
    A.register(spark, d)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.table("part").repartition(tasks, "p_partkey").createOrReplaceTempView("part")
    return spark.sql(A.text(MICRO_PAGES, "spark"))


@query("v7_microdata_status", """SELECT id, CASE id % 4 WHEN 2 THEN 'Article' WHEN 3 THEN 'Recipe' ELSE 'unverified' END AS status,
    CASE id % 4 WHEN 2 THEN 'microdata @type: Article' WHEN 3 THEN 'microdata @type: Recipe' ELSE 'No structured data found' END AS reason FROM (SELECT p_partkey AS id FROM part)""")
def v7_micro(spark, d):
    """Pages with microdata only, or with types that are empty, which are no types."""
    rows = micro_pages(spark, d)
    return validate(rows.withColumn("facts", page_facts(F.col("html")))).select("id", F.col("new_status").alias("status"), "reason")


_COOKED, _DRINK = "Cake", "Negroni"


@query("d16_e4_microdata_recipes", """SELECT id, concat(p_name, CASE id % 3 WHEN 0 THEN ' Negroni' WHEN 1 THEN ' Cake' ELSE ' Salad' END) AS name, concat('Ann site', CAST(id % 14 AS VARCHAR)) AS author, 'microdata' AS source,
    CASE id % 3 WHEN 0 THEN 3 ELSE -4 END AS score FROM (SELECT p_partkey AS id, p_name FROM part) WHERE id % 4 = 3""")
def d16_micro(spark, d):
    """Names, authors and name scores of recipes in microdata."""
    rows = micro_pages(spark, d)
    found = classify_pages(rows.select("id", page_facts(F.col("html")).alias("facts")))
    first = F.get("facts.recipes", F.lit(0))
    return found.where(first.isNotNull()).select("id", first["derived_name"].alias("name"), first["author"].alias("author"), first["source"].alias("source"), "score")


_MAP = "CAST(floor(id / 50) AS BIGINT)"
_KIND = "CAST(floor(id / 50) AS BIGINT) % 7"


@query("s2_malformed_sitemaps", f"""SELECT CASE {_KIND} WHEN 5 THEN concat(url, '?a=1&b=2') ELSE url END AS url, concat('https://maps/', CAST({_MAP} AS VARCHAR), '.xml') AS sitemap_source FROM {{recipes}} WHERE {_KIND} NOT IN (1, 2, 3)""")
def s2_malformed(spark, d):
    """Leaves of 50 urls; of seven one has a bare &, one an unknown entity, one breaks off, one ends in a comment and one escapes its &.  An index for every 1,000 leaves."""
    kind = F.expr(_KIND)
    text = F.concat(F.lit("<url><loc>"), "url", F.when(kind == 1, "?a=1&b=2").when(kind == 2, "&nbsp;").when(kind == 5, "?a=1&amp;b=2").otherwise(""), F.lit("</loc></url>"))
    rows = recipe_pages(spark, d).select(F.expr(_MAP).alias("k"), kind.alias("kind"), text.alias("text"))
    name = F.concat(F.lit("https://maps/"), F.col("k").cast("string"), F.lit(".xml"))
    # A leaf has at most 50 urls and an index at most 1,000 leaves, whatever the table's size.
    end = F.when(F.col("kind") == 3, "</url").when(F.col("kind") == 4, "</urlset><!-- end -->").otherwise("</urlset>")
    leaves = rows.groupBy("k", "kind").agg(F.array_join(F.collect_list("text"), "").alias("body"))
    leaves = leaves.select("k", name.alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", end).alias("xml"))
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    roots = leaves.groupBy(F.floor(F.col("k") / 1000).alias("r")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    roots = roots.select(F.concat(F.lit("https://maps/index-"), F.col("r").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("xml"))
    return expand_sitemap_index(leaves.select("url", "xml").unionByName(roots), roots.select("url"))


@query("w1_discover_buckets", "SELECT DISTINCT url, site FROM {batches}")
def w1_buckets(spark, d):
    """Urls in three batches into a frontier of buckets with membership filters."""
    folder = new_folder(spark, "stream")
    rows = adapted(spark, d, A.URL_BATCHES).select("url", "site")
    rows.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    frontier_at = UrlFrontier(f"{folder}/frontier", BUCKETS)
    discover_to(stream, frontier_at, f"{folder}/state").awaitTermination()
    return frontier_at.read(spark).select("url", "site")


_PARTS = 3


@query("w3_stream_breaker_state", f"""SELECT DISTINCT site FROM (SELECT e.b, l.site, l.status, row_number() OVER (PARTITION BY e.b, l.site ORDER BY l.id DESC) AS rn FROM (VALUES (0), (1), (2)) AS e(b) JOIN {CUT_LOG} l ON l.part <= e.b WHERE l.status <> 'pending') W
    WHERE rn <= 20 GROUP BY b, site HAVING count(*) = 20 AND count(*) FILTER (WHERE status = 'blocked') > 8""")
def w3_state(spark, d):
    """The whole log in three batches of four files each: the sites that trip the breaker at the end of any batch."""
    folder = new_folder(spark, "stream")
    log = adapted(spark, d, A.FETCH_LOG)
    part = F.floor(F.col("id") * _PARTS / (1 + F.col("most"))).cast("int")
    cut = log.join(F.broadcast(log.agg(F.max("id").alias("most")))).withColumn("part", part).select(*log.columns, "part")
    for k in range(_PARTS):  # the older first
        cut.where(F.col("part") == k).drop("part").repartition(4).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    try:
        out = jobs.stream_breaker_state(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
    return spark.read.schema("site string, blocked long").parquet(f"{folder}/out").select("site")


@query("x2_nodes_without_helper", f"SELECT id, list_transform(nodes, lambda n: CAST(json(n) AS VARCHAR)) AS nodes, id % 17 <> 0 AND id % 5 = 3 AS by_helper FROM {_NODES}")
def x2_plain(spark, d):
    """JSON-LD objects of recipe pages by Spark's functions; only pages with a malformed block go through Python."""
    return jsonld_nodes(recipe_pages(spark, d).select("id", "html")).select("id", "nodes", "by_helper")


_EIGHTS = "SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS k FROM orders"


@query("t3_closure_of_orders", f"""SELECT a.o_orderkey AS ancestor, b.o_orderkey AS descendant, CAST(b.k - a.k AS INT) AS depth FROM ({_EIGHTS}) a JOIN ({_EIGHTS}) b
    ON a.o_custkey = b.o_custkey AND CAST(floor(a.k / 8) AS BIGINT) = CAST(floor(b.k / 8) AS BIGINT) AND a.k < b.k""")
def t3_orders(spark, d):
    """The closure of chains of eight orders of every customer."""
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    edges = spark.sql(f"SELECT a.o_orderkey AS parent_id, b.o_orderkey AS child_id FROM ({_EIGHTS}) a JOIN ({_EIGHTS}) b ON a.o_custkey = b.o_custkey AND b.k = a.k + 1 AND b.k % 8 <> 0")
    return taxonomy.taxonomy_closure(edges)
