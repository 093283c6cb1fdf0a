"""The given tables in the shapes that the operators take.

Each adapter is one SQL text that Spark and DuckDB read alike; the few functions
that they name differently are filled in.  Views of the given tables must exist:
``register`` makes them in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "orders", "lineitem", "part", "events", "pages", "documents", "labels")

_SITE = """CASE WHEN o_custkey % 14 < 7 THEN 'diffordsguide' WHEN o_custkey % 14 = 7 THEN 'foodnetwork' WHEN o_custkey % 14 = 8 THEN 'imbibe'
  WHEN o_custkey % 14 = 9 THEN 'bonappetit' WHEN o_custkey % 14 = 10 THEN 'punch' WHEN o_custkey % 14 = 11 THEN 'liquor' WHEN o_custkey % 14 = 12 THEN 'saveur' ELSE 'seriouseats' END"""

FRONTIER = f"""
SELECT id, site, concat('https://www.', site, '.com', path, CAST(id AS STRING)) AS url, status, content_type, sitemap_source, attempts, discovered_at,
       CAST(NULL AS TIMESTAMP) AS fetched_at, CAST(NULL AS STRING) AS fetch_error,
       CASE WHEN id % 3 = 0 THEN NULL ELSE concat(site, '/', CAST(id AS STRING), '.html') END AS html_path,
       CASE WHEN id % 11 = 0 THEN 'manual' END AS disabled_reason
FROM (
  SELECT o_orderkey AS id, {_SITE} AS site,
    CASE (o_orderkey + o_custkey) % 10 WHEN 0 THEN '/encyclopedia/a/bars/' WHEN 1 THEN '/encyclopedia/a/company-info/' WHEN 2 THEN '/videos/'
      WHEN 3 THEN '/drink-of-the-week-' WHEN 4 THEN '/recipes/articles/' WHEN 5 THEN '/story/' WHEN 6 THEN '/Recipes/Articles/' WHEN 7 THEN '/Encyclopedia/b/EVENTS/' ELSE '/recipe/' END AS path,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'blocked' ELSE 'Recipe' END AS status,
    CASE o_orderkey % 6 WHEN 0 THEN 'likely_drink_recipe' WHEN 1 THEN 'confirmed_drink' WHEN 2 THEN 'likely_food_recipe' WHEN 3 THEN 'likely_junk' WHEN 4 THEN 'confirmed_food' END AS content_type,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('sitemap-', CAST(o_orderkey % 3 AS STRING), '.xml') END AS sitemap_source,
    CAST(o_orderkey % 4 AS INT) AS attempts, o_orderdate AS discovered_at
  FROM orders) t"""

URL_BATCHES = """
SELECT concat('https://www.punch.com/p/', CAST(l_partkey AS STRING)) AS url, 'punch' AS site, concat('sitemap-', l_returnflag, '.xml') AS sitemap_source,
       l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3, l_shipdate AS o4, l_extendedprice AS o5, l_quantity AS o6, l_discount AS o7, l_tax AS o8
FROM lineitem"""

EVAL_ROWS = """
SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS run_id, l_returnflag AS validator_version, l_shipdate AS evaluated_at,
       CASE WHEN l_linestatus = 'F' THEN 'blocked' ELSE 'Recipe' END AS status, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN 'blocked' ELSE 'Recipe' END AS pages_status_before,
       l_extendedprice AS price, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_discount AS disc, l_tax AS tax
FROM lineitem"""

EXTRACT_RUNS = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN 'extracted' WHEN 1 THEN 'no_recipe' ELSE 'html_missing' END AS outcome
FROM orders WHERE o_orderkey % 7 < 3"""

FETCH_LOG = """
SELECT event_id AS id, CAST(user_id AS STRING) AS site, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'pending' ELSE event_type END AS status FROM events"""

_Q = '"'
RECIPE_PAGES = """
WITH lines AS (
  SELECT l_partkey AS pk, @lines@ AS ing, min(n) AS n FROM (
    SELECT l_partkey, l_suppkey % 8 AS n, CASE l_suppkey % 8 WHEN 0 THEN '2 oz gin' WHEN 1 THEN '1 dash Angostura bitters' WHEN 2 THEN '3 cups flour' WHEN 3 THEN '1/2 oz Campari'
      WHEN 4 THEN '2 tsp sugar' WHEN 5 THEN 'ice' WHEN 6 THEN '1 oz sweet vermouth' ELSE '200 ml lime juice' END AS line FROM lineitem) x GROUP BY l_partkey),
texts AS (
  SELECT p.*, ing, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' Negroni' WHEN 1 THEN ' Sour' WHEN 2 THEN ' Cake' WHEN 3 THEN ' Salad' WHEN 4 THEN '' ELSE ' Martini Cake' END) AS title,
    CASE (p_partkey + p_size) % 7 WHEN 0 THEN 'Shake the gin with plenty of ice.' WHEN 1 THEN 'Preheat the oven to 350 degrees.' WHEN 2 THEN 'Muddle the mint and rim the glass.' WHEN 3 THEN 'Stir well.'
      WHEN 4 THEN 'Shake one two three four five six seven eight nine ice.' WHEN 5 THEN 'Bake it at 200 until done.' ELSE 'Mix.' END AS first_step,
    CASE p_partkey % 3 WHEN 0 THEN 'Strain into a chilled coupe glass.' WHEN 1 THEN 'Serve.' ELSE 'Strain a b c d e f g h i j k cup.' END AS second_step
  FROM part p JOIN lines ON pk = p_partkey),
objects AS (
  SELECT *, concat('{"@context":"https://schema.org","@type":', CASE WHEN p_partkey % 9 = 0 THEN '["Thing","http://schema.org/Recipe"]' ELSE '"Recipe"' END, ',"name":"', title, '","author":',
    CASE p_partkey % 4 WHEN 0 THEN '"Ann Lee"' WHEN 1 THEN '{"@type":"Person","name":"Bo Fry"}' WHEN 2 THEN '[{"name":"Cy Orr"},"Di Ray"]' ELSE 'null' END, ',"image":',
    CASE p_partkey % 5 WHEN 0 THEN concat('"https://img.com/', CAST(p_partkey AS STRING), '.jpg"') WHEN 1 THEN '{"url":"https://img.com/o.jpg"}' WHEN 2 THEN '["https://img.com/a.jpg","https://img.com/a.jpg","https://img.com/b.jpg"]' ELSE '[]' END, ',"recipeYield":',
    CASE p_size % 6 WHEN 0 THEN '2' WHEN 1 THEN '"Serves 2"' WHEN 2 THEN '"1"' WHEN 3 THEN '["4","2 cocktails"]' WHEN 4 THEN '12' ELSE 'null' END, ',"recipeIngredient":["', ing, '"],"recipeCategory":',
    CASE p_size % 5 WHEN 0 THEN '"Cocktails"' WHEN 1 THEN '["Dinner","Drink"]' WHEN 2 THEN '"Dessert"' ELSE 'null' END, ',"keywords":"', CASE p_size % 7 WHEN 0 THEN 'gin, highball' ELSE 'easy, quick' END,
    '","cookTime":"PT', CAST(p_size AS STRING), 'M","totalTime":"PT', CAST(p_size % 3 AS STRING), 'H', CAST(p_size AS STRING), 'M","recipeInstructions":',
    CASE p_size % 4 WHEN 0 THEN concat('"', first_step, ' ', second_step, '"') WHEN 1 THEN concat('["', first_step, '","', second_step, '"]')
      WHEN 2 THEN concat('[{"@type":"HowToStep","text":"', first_step, '"},{"@type":"HowToStep","text":"', second_step, '"}]')
      ELSE concat('[{"@type":"HowToSection","name":"Make","itemListElement":[{"text":"', first_step, '"},{"text":"', second_step, '"}]}]') END,
    ',"url":"https://www.site', CAST(p_partkey % 14 AS STRING), '.com/r/', CAST(p_partkey AS STRING), '"}') AS object FROM texts)
SELECT p_partkey AS id, concat('site', CAST(p_partkey % 14 AS STRING)) AS site, concat('https://www.site', CAST(p_partkey % 14 AS STRING), '.com/r/', CAST(p_partkey AS STRING)) AS url,
  CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'Recipe' ELSE 'blocked' END AS status,
  CASE p_partkey % 4 WHEN 0 THEN 'confirmed_drink' WHEN 1 THEN 'likely_drink_recipe' WHEN 2 THEN 'confirmed_food' END AS content_type,
  concat('<html><head>', CASE WHEN p_partkey % 13 = 0 THEN '<link rel="canonical" href="https://other.com/x">' WHEN p_partkey % 13 = 1 THEN concat('<LINK href="/a" rel="canonical" href="https://site', CAST(p_partkey % 14 AS STRING), '.com/y">') ELSE '' END,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(CASE p_partkey % 5 WHEN 3 THEN '<script type="application/ld+json">{"broken":</script>' WHEN 4 THEN '<script type="application/ld+json">{"@type":"Article","name":"Wrapper"}</script>' ELSE '' END,
      '<script type="application/ld+json">', CASE p_partkey % 5 WHEN 1 THEN concat('{"@graph":[{"@type":"WebPage","name":"W"},', object, ']}') WHEN 2 THEN concat('[', object, ',{"@type":"WebSite"}]') ELSE object END, '</script>') END,
    '</head><body><p>', title, '</p></body></html>') AS html
FROM objects"""

CRAWL_PAGES = """
SELECT id, url, concat(CASE id % 12 WHEN 0 THEN '<meta content="noindex">' WHEN 1 THEN '<div class="g-recaptcha">' WHEN 2 THEN '<title>Page Not Found</title>' WHEN 3 THEN '<p>Access Denied</p>' ELSE '' END, html,
       CASE WHEN id % 2 = 0 THEN repeat('<p>filler words of the page go here</p>', 200) ELSE '' END) AS html
FROM (SELECT page_id AS id, url, coalesce(html, '') AS html FROM pages) t"""

TAX_EDGES = """
SELECT parent_id, child_id FROM (
  SELECT 1000 AS parent_id, 100 + r_regionkey AS child_id FROM region
  UNION ALL SELECT 100 + n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 100, n_nationkey FROM nation WHERE n_nationkey % 4 = 0) t"""

_FILL = {"spark": {"@lines@": "array_join(sort_array(collect_set(line)), '\",\"')"}, "duckdb": {"@lines@": "array_to_string(list_sort(list(DISTINCT line)), '\",\"')"}}


def text(adapter: str, engine: str) -> str:
    for mark, value in _FILL[engine].items():
        adapter = adapter.replace(mark, value)
    return adapter


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def adapted(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(text(adapter, "spark"))
