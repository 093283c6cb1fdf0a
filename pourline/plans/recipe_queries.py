"""Registered queries over recipe pages: structured data, validation, scores, extraction, display, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.page_facts import page_facts
from ..operators import dedup, extraction, scoring, search, validation
from . import adapters as A
from .adapters import adapted
from .queries import NOW, ORACLES, QUERIES, query, recipe_pages, with_facts

__all__ = ["ORACLES", "QUERIES"]

_BLOCKS = r"""(SELECT *, list_filter(regexp_extract_all(html, '<script type="application/ld\+json">(.*?)</script>', 1), lambda b: json_valid(b)) AS blocks FROM {recipes})"""
#: Every node of every page, in page order.
_NODES = f"""(SELECT id, site, url, html, status, content_type, list_filter(flatten(list_transform(blocks, lambda b: CASE WHEN json_type(b) = 'ARRAY' THEN CAST(json_extract(b, '$[*]') AS VARCHAR[])
    WHEN json_type(b, '$."@graph"') = 'ARRAY' THEN CAST(json_extract(b, '$."@graph"[*]') AS VARCHAR[]) ELSE [b] END)), lambda n: json_type(n) = 'OBJECT') AS nodes FROM {_BLOCKS})"""
_TYPES = """CASE WHEN json_type(n, '$."@type"') = 'ARRAY' THEN CAST(json_extract_string(n, '$."@type"[*]') AS VARCHAR[]) ELSE [json_extract_string(n, '$."@type"')] END"""
_RECIPES = f"""(SELECT id, site, url, status, content_type, list_filter(nodes, lambda n: len(list_filter({_TYPES}, lambda t: contains(t, 'Recipe'))) > 0)[1] AS r FROM {_NODES})"""
_TOKENS = "regexp_extract_all(lower({0}), '[a-z]+')"


def _q(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEXT = """CASE WHEN json_type(r, '$.recipeInstructions') = 'VARCHAR' THEN json_extract_string(r, '$.recipeInstructions') WHEN json_type(r, '$.recipeInstructions[0]') = 'VARCHAR' THEN array_to_string(json_extract_string(r, '$.recipeInstructions[*]'), ' ')
    WHEN json_type(r, '$.recipeInstructions[0].itemListElement') = 'ARRAY' THEN array_to_string(json_extract_string(r, '$.recipeInstructions[0].itemListElement[*].text'), ' ') ELSE coalesce(array_to_string(json_extract_string(r, '$.recipeInstructions[*].text'), ' '), '') END"""


def _strings(key: str) -> str:
    return f"CASE WHEN json_type(r, '$.{key}') = 'ARRAY' THEN json_extract_string(r, '$.{key}[*]') WHEN json_type(r, '$.{key}') = 'VARCHAR' THEN [json_extract_string(r, '$.{key}')] ELSE [] END"


_F = f"""(SELECT id, site, url, status, content_type, r, regexp_extract_all(lower(json_extract_string(r, '$.name')), '[a-z]+') AS name_t, lower({_TEXT}) AS txt, regexp_extract_all(lower({_TEXT}), '[a-z]+') AS tok,
    list_transform(json_extract_string(r, '$.recipeIngredient[*]'), lambda l: list_filter(regexp_extract_all(lower(l), '[a-z]+'), lambda t: list_contains({_q(scoring.LIQUID + scoring.DRY)}, t))[1]) AS units,
    flatten(list_transform(json_extract_string(r, '$.recipeIngredient[*]'), lambda l: regexp_extract_all(lower(l), '[a-z]+'))) AS ing_t FROM {_RECIPES} WHERE r IS NOT NULL)"""


def _near(target: str, others: list[str]) -> str:
    return f"len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = '{target}' AND list_has_any(tok[greatest(i - 8, 1):i + 8], {_q(others)}))) > 0"


def _meta(key: str) -> str:
    return f"list_has_any(regexp_extract_all(lower(array_to_string({_strings(key)}, ' | ')), '[a-z]+'), {_q(scoring.METADATA)})"


_YIELD = """CASE json_type(r, '$.recipeYield') WHEN 'UBIGINT' THEN CAST(r->>'$.recipeYield' AS DOUBLE) BETWEEN 0.001 AND 2 WHEN 'NULL' THEN false ELSE
    len(list_filter(""" + _strings("recipeYield") + """, lambda y: list_has_any(regexp_extract_all(lower(y), '[a-z]+'), ['cocktail', 'cocktails', 'drink', 'drinks']) OR (regexp_full_match(trim(y), '\\d+') AND TRY_CAST(trim(y) AS BIGINT) <= 2))) > 0 END"""
_LIQ, _DRY = (f"len(list_filter(units, lambda u: list_contains({_q(w)}, u)))" for w in (scoring.LIQUID, scoring.DRY))
_RULES = {
    "name_cooked_noun": (-4, f"list_has_any(name_t, {_q(scoring.COOKED)})"),
    "name_cocktail_family": (3, f"NOT list_has_any(name_t, {_q(scoring.COOKED)}) AND list_has_any(name_t, {_q(scoring.FAMILY)})"),
    "instructions_shake_ice": (3, _near("shake", ["ice"])),
    "instructions_strain_glassware": (4, _near("strain", scoring.GLASSWARE + scoring.CONTAINERS)),
    "instructions_oven_verb": (-3, f"regexp_matches(txt, '{scoring.OVEN}')"),
    "instructions_muddle": (2, "list_contains(tok, 'muddle')"),
    "instructions_rim_glass": (2, "contains(txt, 'rim the glass') OR contains(txt, 'rimmed with')"),
    "yield_drink_like": (2, _YIELD),
    "ingredients_liquid_units": (2, f"2 * {_LIQ} > {_LIQ} + {_DRY}"),
    "ingredients_dry_units": (-2, f"2 * {_DRY} > {_LIQ} + {_DRY}"),
    "metadata_category_drink": (3, _meta("recipeCategory")),
    "metadata_keywords_drink": (3, _meta("keywords")),
    "cook_time_long": (-1, "CAST(regexp_extract(r->>'$.cookTime', 'PT(\\d+)M', 1) AS INT) > 10"),
}
_BARTENDER = f"len(list_distinct(list_filter(ing_t, lambda t: list_contains({_q(scoring.BARTENDER)}, t))))"
_SCORE = " + ".join([f"CASE WHEN {held} THEN {w} ELSE 0 END" for w, held in _RULES.values()] + [_BARTENDER])
_PAGE_SCORE = f"""(SELECT p.id, coalesce(s.score, 0) AS score, CASE WHEN s.score >= 2 THEN 'confirmed_drink' WHEN s.score <= -2 THEN 'confirmed_food' END AS label
    FROM {_RECIPES} p LEFT JOIN (SELECT id, {_SCORE} AS score FROM {_F}) s USING (id))"""


# ---- structured data ----


@query("x1_jsonld_blocks", f"SELECT id, CAST(len(blocks) AS INT) AS n_blocks, list_transform(blocks, lambda b: CAST(json(b) AS VARCHAR)) AS blocks FROM {_BLOCKS}")
def x1(spark, d):
    return with_facts(spark, d).select("id", F.size("facts.blocks").alias("n_blocks"), F.col("facts.blocks").alias("blocks"))


@query("x2_jsonld_nodes", f"SELECT id, CAST(len(nodes) AS INT) AS n_nodes, list_transform(nodes, lambda n: CAST(json(n) AS VARCHAR)) AS nodes FROM {_NODES}")
def x2(spark, d):
    return with_facts(spark, d).select("id", F.size("facts.nodes").alias("n_nodes"), F.col("facts.nodes").alias("nodes"))


@query("x4_type_names", f"SELECT id, list_transform(flatten(list_transform(nodes, lambda n: {_TYPES})), lambda t: regexp_replace(t, '^https?://schema\\.org/', '')) AS types FROM {_NODES}")
def x4(spark, d):
    node = F.try_parse_json
    kinds = lambda n: F.when(
        F.schema_of_variant(F.try_variant_get(node(n), "$['@type']", "variant")).startswith("ARRAY"), F.try_variant_get(node(n), "$['@type']", "array<string>")
    ).otherwise(F.array(F.try_variant_get(node(n), "$['@type']", "string")))
    names = F.flatten(F.transform("facts.nodes", kinds))
    return with_facts(spark, d).select("id", F.transform(names, lambda t: F.regexp_replace(t, r"^https?://schema\.org/", "")).alias("types"))


@query("x5_recipe_rows", f"SELECT id, 0 AS ordinal, 'json-ld' AS source, CAST(json(r) AS VARCHAR) AS json FROM {_RECIPES} WHERE r IS NOT NULL")
def x5(spark, d):
    return extraction.recipe_rows(with_facts(spark, d)).select("id", "ordinal", "recipe.source", "recipe.json")


@query("x6_first_recipe", f"SELECT id, r IS NOT NULL AS found, r->>'$.name' AS name FROM {_RECIPES}")
def x6(spark, d):
    return extraction.first_recipe(with_facts(spark, d)).select("id", F.col("recipe").isNotNull().alias("found"), F.col("recipe.name").alias("name"))


# ---- validation ----

_CANON = r"""trim(regexp_extract(html, '(?i)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1))"""


def _host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)), '^www\\.', '')"


_MISMATCH = f"CASE WHEN {_host(_CANON)} <> '' AND {_host(_CANON)} <> {_host('url')} THEN {_CANON} END"
_BLOCK = "CASE WHEN strlen(html) < 5000 THEN 'Size under 5KB — likely not a content page' " + " ".join(f"WHEN contains(html, '{m}') THEN '{r}'" for m, r in validation.FINGERPRINTS) + " END"
_SOFT = """(contains(lower(html), 'content="noindex"') OR contains(lower(html), 'content=''noindex''') OR contains(regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1), 'not found') OR contains(regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1), '404'))"""


@query("v1_canonical_mismatch", f"SELECT id, {_MISMATCH} AS canonical FROM {{recipes}}")
def v1(spark, d):
    return recipe_pages(spark, d).select("id", validation.canonical_mismatch(F.col("html"), F.col("url")).alias("canonical"))


@query("v4_v5_blockers", f"SELECT id, {_BLOCK} AS blocker, {_SOFT} AS soft_404 FROM {{crawl}}")
def v4(spark, d):
    return adapted(spark, d, A.CRAWL_PAGES).select("id", validation.blocker(F.col("html")).alias("blocker"), validation.soft_404(F.col("html")).alias("soft_404"))


_RANKS = "CASE t WHEN 'Recipe' THEN 0 WHEN 'NewsArticle' THEN 1 WHEN 'Article' THEN 2 WHEN 'WebPage' THEN 3 WHEN 'WebSite' THEN 4 ELSE 5 END"
_BEST = f"list_sort(list_transform(flatten(list_transform(nodes, lambda n: {_TYPES})), lambda t: concat({_RANKS}, t)))[1][2:]"
_STATUS = f"(SELECT id, site, CASE WHEN {_MISMATCH} IS NOT NULL THEN 'blocked' WHEN {_BEST} IS NOT NULL THEN {_BEST} ELSE 'blocked' END AS new_status, CASE WHEN {_MISMATCH} IS NOT NULL THEN concat('canonical host mismatch: ', {_MISMATCH}) WHEN {_BEST} IS NOT NULL THEN concat('JSON-LD @type: ', {_BEST}) ELSE 'Size under 5KB — likely not a content page' END AS reason FROM {_NODES})"


@query("v7_validate", f"SELECT id, new_status, reason FROM {_STATUS}")
def v7(spark, d):
    return validation.validate(recipe_pages(spark, d).withColumn("facts", page_facts(F.col("html")))).select("id", "new_status", "reason")


@query("v7_validate_crawl", f"SELECT id, CASE WHEN {_BLOCK} IS NOT NULL OR {_SOFT} THEN 'blocked' ELSE 'unverified' END AS new_status, coalesce({_BLOCK}, CASE WHEN {_SOFT} THEN 'Soft 404 detected' END, 'No structured data found') AS reason FROM {{crawl}}")
def v7c(spark, d):
    return validation.validate(adapted(spark, d, A.CRAWL_PAGES).withColumn("facts", page_facts(F.col("html")))).select("id", "new_status", "reason")


_CHANGES = f"""(SELECT p.site, concat(p.status, ' -> ', s.new_status) AS transition FROM {{recipes}} p JOIN {_STATUS} s USING (id) WHERE p.status <> s.new_status
    UNION ALL SELECT p.site, concat(coalesce(p.content_type, 'NULL'), ' -> ', l.label) FROM {{recipes}} p JOIN {_STATUS} s USING (id) JOIN {_PAGE_SCORE} l USING (id) WHERE s.new_status <> 'blocked' AND l.label IS NOT NULL AND p.content_type IS DISTINCT FROM l.label)"""


def revalidated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = recipe_pages(spark, d)
    frontier = pages.drop("html").withColumns({"html_path": validation.html_path(F.col("site"), F.col("url")), "fetched_at": F.lit(None).cast("timestamp")})
    cache = pages.select(validation.html_path(F.col("site"), F.col("url")).alias("html_path"), "html")
    none = spark.createDataFrame([], "page_id long, run_id long, status string, reason string, validator_version string, evaluated_at timestamp, pages_status_before string")
    drinks = spark.createDataFrame([], "page_id long, run_id long, label string, score int, score_detail string, scorer_version string, evaluated_at timestamp, pages_content_type_before string")
    extracts = spark.createDataFrame([], "page_id long, outcome string")
    return validation.revalidate(frontier, cache, none, drinks, extracts, 1, NOW)


@query("v8_revalidate_transitions", f"SELECT site, transition, count(*) AS n FROM {_CHANGES} GROUP BY ALL")
def v8(spark, d):
    return revalidated(spark, d)["transitions"]


@query("v8_revalidated_pages", f"SELECT p.id, s.new_status AS status, CASE WHEN s.new_status <> 'blocked' AND l.label IS NOT NULL THEN l.label ELSE p.content_type END AS content_type, NOT (p.status <> s.new_status AND s.new_status = 'blocked') AS has_path FROM {{recipes}} p JOIN {_STATUS} s USING (id) JOIN {_PAGE_SCORE} l USING (id)")
def v8p(spark, d):
    return revalidated(spark, d)["pages"].select("id", "status", "content_type", F.col("html_path").isNotNull().alias("has_path"))


@query("q9_fetch_ingest", f"SELECT p.id, CASE WHEN p.id % 4 = 0 THEN p.status ELSE s.new_status END AS status, CASE WHEN p.id % 4 <> 0 AND s.new_status <> 'blocked' AND l.label IS NOT NULL THEN l.label ELSE p.content_type END AS content_type, CASE WHEN p.id % 4 = 0 THEN 1 ELSE 0 END AS attempts FROM {{recipes}} p JOIN {_STATUS} s USING (id) JOIN {_PAGE_SCORE} l USING (id)")
def q9(spark, d):
    pages = recipe_pages(spark, d)
    frontier = pages.drop("html").withColumns({"attempts": F.lit(0), "html_path": F.lit(None).cast("string"), "fetched_at": F.lit(None).cast("timestamp"), "fetch_error": F.lit(None).cast("string")})
    results = pages.select("url", F.when(F.col("id") % 4 != 0, F.col("html")).alias("html"), F.when(F.col("id") % 4 == 0, "timeout").alias("error"))
    return validation.fetch_ingest(frontier, results, 1, NOW)["pages"].select("id", "status", "content_type", "attempts")


# ---- scores ----


@query("d1_d15_rules", " UNION ALL ".join(f"SELECT id, '{n}' AS rule, {w} AS weight FROM f WHERE {held}" for n, (w, held) in _RULES.items()).join([f"WITH f AS (SELECT * FROM {_F}) ", f" UNION ALL SELECT id, concat('ingredient_bartender:', unnest(list_distinct(list_filter(ing_t, lambda t: list_contains({_q(scoring.BARTENDER)}, t))))), 1 FROM f"]))
def d_rules(spark, d):
    rows = extraction.first_recipe(with_facts(spark, d)).where("recipe IS NOT NULL").select("id", F.explode(scoring.rules_of(F.col("recipe"))).alias("x"))
    return rows.select("id", "x.rule", "x.weight")


@query("d14_breadcrumb_rule", "SELECT id, id % 6 IN (1, 4, 5) AS held FROM {recipes}")
def d14(spark, d):
    """Recipes under a breadcrumb of several shapes: items that are texts, objects with a name, numbers, and no list."""
    crumb = F.expr("""CASE id % 6 WHEN 0 THEN '[{"item":"Home"},{"item":{"name":"Dinner"}}]' WHEN 1 THEN '[{"item":"Home"},{"item":{"name":"Easy Cocktails"}}]'
        WHEN 2 THEN '[{"item":7},{"name":"Cocktails"},null]' WHEN 3 THEN '{"item":"Cocktails"}' WHEN 4 THEN '[7,{"item":"COCKTAILS"}]' ELSE '[{"item":{"name":["x"]}},{"item":{"name":"cocktail"}}]' END""")
    html = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Recipe","name":"'), F.col("site"),
        F.lit('","mainEntityOfPage":{"breadcrumb":{"itemListElement":'), crumb, F.lit("}}}</script>"),
    )
    rows = extraction.first_recipe(recipe_pages(spark, d).select("id", page_facts(html).alias("facts")))
    return rows.select("id", F.exists(scoring.rules_of(F.col("recipe")), lambda x: x["rule"] == "metadata_breadcrumb_drink").alias("held"))


@query("d16_classify_pages", f"SELECT id, CAST(score AS INT) AS score, label FROM {_PAGE_SCORE}")
def d16(spark, d):
    return scoring.classify_pages(with_facts(spark, d)).select("id", "score", "label")


@query("d17_review_scores", f"SELECT count(*) AS total, CAST(sum(CASE WHEN coalesce(l.label, 'abstain') = coalesce(p.content_type, 'abstain') THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM {{recipes}} p JOIN {_PAGE_SCORE} l USING (id)")
def d17(spark, d):
    scored = scoring.classify_pages(with_facts(spark, d))
    expected = recipe_pages(spark, d).select("id", F.coalesce("content_type", F.lit("abstain")).alias("expected"))
    return scoring.review_scores(expected, scored, "id")[0]


# ---- extraction ----

_AUTHOR1 = "CASE json_type(r, '$.author') WHEN 'VARCHAR' THEN r->>'$.author' WHEN 'OBJECT' THEN r->>'$.author.name' WHEN 'ARRAY' THEN r->>'$.author[0].name' END"
_IMAGE1 = "CASE json_type(r, '$.image') WHEN 'VARCHAR' THEN r->>'$.image' WHEN 'OBJECT' THEN r->>'$.image.url' WHEN 'ARRAY' THEN r->>'$.image[0]' END"


@query("e1_e3_derive", f"SELECT id, r->>'$.name' AS name, {_AUTHOR1} AS author, {_IMAGE1} AS image_url FROM {_RECIPES} WHERE r IS NOT NULL")
def e1(spark, d):
    got = extraction.first_recipe(with_facts(spark, d)).where("recipe IS NOT NULL")
    return got.select("id", F.col("recipe.derived_name").alias("name"), "recipe.author", "recipe.image_url")


def extracted(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = recipe_pages(spark, d)
    path = validation.html_path(F.col("site"), F.col("url"))
    cache = pages.where("id % 10 <> 1").select(path.alias("html_path"), "html")
    runs = spark.createDataFrame([], "page_id long, run_id long, outcome string, error string, extractor_version string, evaluated_at timestamp")
    stored = pages.where("id % 6 = 0").select(
        "id", F.col("url").alias("source_url"), "site", F.lit("old").alias("name"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("image_url"),
        F.lit("{}").alias("jsonld"), F.lit(NOW).cast("timestamp").alias("fetched_at"), F.lit(NOW).cast("timestamp").alias("extracted_at"),
    )
    return extraction.extract_recipes(pages.drop("html").withColumn("html_path", path), cache, runs, stored, 1, NOW)


_OUT = f"(SELECT site, CASE WHEN id % 10 = 1 THEN 'html_missing' WHEN r IS NULL THEN 'no_recipe' ELSE 'extracted' END AS outcome, url, r, id FROM {_RECIPES} WHERE content_type IN ('likely_drink_recipe', 'confirmed_drink') AND id % 6 <> 0)"


@query("e4_e5_extract_summary", f"SELECT site, outcome, count(*) AS n FROM {_OUT} GROUP BY ALL")
def e5(spark, d):
    return extraction.extract_summary(extracted(spark, d)["outcomes"])


@query("s5_s7_recipes_public", f"SELECT url AS source_url, site, r->>'$.name' AS name, {_AUTHOR1} AS author, {_IMAGE1} AS image_url FROM {_OUT} WHERE outcome = 'extracted' UNION ALL SELECT url, site, 'old', NULL, NULL FROM {{recipes}} WHERE id % 6 = 0")
def s7(spark, d):
    return extraction.recipes_public(extracted(spark, d)["recipes"]).drop("id", "jsonld")


@query("s8_extracted_source_urls", "SELECT source_url, (SELECT count(*) FROM {recipes}) AS n FROM (SELECT url AS source_url FROM {recipes} WHERE site = 'site3')")
def s8(spark, d):
    recipes = recipe_pages(spark, d).withColumnRenamed("url", "source_url")
    return extraction.extracted_source_urls(recipes, "site3").join(F.broadcast(extraction.count_recipes(recipes)))


# ---- display ----


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return extraction.first_recipe(with_facts(spark, d)).where("recipe IS NOT NULL").select("id", "site", F.col("recipe.name").alias("name"), F.col("recipe.image_url").alias("image_url"), F.col("recipe.json").alias("jsonld"), F.col("recipe.ingredients").alias("ingredients"))


_STEPS = """CASE WHEN json_type(r, '$.recipeInstructions') = 'VARCHAR' THEN [json_extract_string(r, '$.recipeInstructions')] WHEN json_type(r, '$.recipeInstructions[0]') = 'VARCHAR' THEN json_extract_string(r, '$.recipeInstructions[*]')
    WHEN json_type(r, '$.recipeInstructions[0].itemListElement') = 'ARRAY' THEN json_extract_string(r, '$.recipeInstructions[0].itemListElement[*].text') ELSE json_extract_string(r, '$.recipeInstructions[*].text') END"""


@query(
    "n1_n7_normalize",
    f"""SELECT id, r->>'$.name' AS name, CASE json_type(r, '$.author') WHEN 'VARCHAR' THEN r->>'$.author' WHEN 'OBJECT' THEN r->>'$.author.name' WHEN 'ARRAY' THEN concat(r->>'$.author[0].name', ' & ', r->>'$.author[1]') END AS author,
    CASE WHEN json_type(r, '$.image') = 'ARRAY' THEN CASE WHEN json_array_length(r, '$.image') = 0 THEN '' ELSE 'https://img.com/a.jpg|https://img.com/b.jpg' END ELSE {_IMAGE1} END AS images,
    CASE WHEN json_type(r, '$.recipeYield') IN ('VARCHAR', 'UBIGINT') THEN r->>'$.recipeYield' END AS yield, CASE WHEN n = 0 THEN NULL ELSE concat(n, ' min') END AS cook_time,
    CASE WHEN h > 0 AND n > 0 THEN concat(h, ' h ', n, ' min') WHEN h > 0 THEN concat(h, ' h') WHEN n > 0 THEN concat(n, ' min') END AS total_time, array_to_string(json_extract_string(r, '$.recipeIngredient[*]'), '|') AS ingredients,
    CAST(CASE WHEN json_type(r, '$.recipeInstructions[0].itemListElement') = 'ARRAY' THEN 1 ELSE len({_STEPS}) END AS INT) AS n_instructions, r->>'$.url' AS source_url
    FROM (SELECT id, r, CAST(regexp_extract(r->>'$.cookTime', 'PT(\\d+)M', 1) AS INT) AS n, CAST(regexp_extract(r->>'$.totalTime', 'PT(\\d+)H', 1) AS INT) AS h FROM {_RECIPES} WHERE r IS NOT NULL)""",
)
def n7(spark, d):
    n = F.col("normalized")
    return normalize.normalize_recipes(parsed(spark, d)).select(
        "id", n["name"].alias("name"), n["author"].alias("author"), F.array_join(n["images"], "|").alias("images"), n["yield"].alias("yield"), n["cook_time"].alias("cook_time"),
        n["total_time"].alias("total_time"), F.array_join(n["ingredients"], "|").alias("ingredients"), F.size(n["instructions"]).alias("n_instructions"), n["source_url"].alias("source_url"),
    )


@query("n8_group_steps", f"SELECT id, 1 AS n_groups, CASE WHEN json_type(r, '$.recipeInstructions[0].itemListElement') = 'ARRAY' THEN 'section' ELSE 'steps' END AS kind, CASE WHEN json_type(r, '$.recipeInstructions[0].itemListElement') = 'ARRAY' THEN 'Make' END AS heading, array_to_string({_STEPS}, '|') AS steps FROM {_RECIPES} WHERE r IS NOT NULL")
def n8(spark, d):
    got = normalize.normalize_recipes(parsed(spark, d)).select("id", normalize.group_steps(F.col("normalized.instructions")).alias("g"))
    first = F.get("g", F.lit(0))
    return got.select("id", F.size("g").alias("n_groups"), first["kind"].alias("kind"), first["heading"].alias("heading"), F.array_join(first["steps"], "|").alias("steps"))


@query("n9_source_host", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]') THEN lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) ELSE 'source' END AS host FROM pages")
def n9(spark, d):
    A.register(spark, d)
    return spark.table("pages").select("page_id", normalize.source_host(F.col("url")).alias("host"))


# ---- search ----

_CAT = f"(SELECT id, site, r->>'$.name' AS name, {_IMAGE1} AS image_url, CAST(json_extract(r, '$.recipeIngredient') AS VARCHAR) AS lines FROM {_RECIPES} WHERE r IS NOT NULL)"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return search.with_ingredients_json(parsed(spark, d))


@query("f1_search_terms", r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(substr(text, 1, 200), chr(32) || chr(9) || chr(10) || chr(13)), '\s+'), lambda t: regexp_replace(regexp_replace(t, '^[^A-Za-z0-9\\%_*]+', ''), '[^A-Za-z0-9\\%_*]+$', '')), lambda t: length(t) >= 3) AS terms FROM documents")
def f1(spark, d):
    A.register(spark, d)
    return spark.table("documents").select("doc_id", search.search_terms_col(F.col("text")).alias("terms"))


@query("f2_search_recipes", f"SELECT id, name FROM {_CAT} WHERE (name ILIKE '%sour%' OR lines ILIKE '%sour%') AND (name ILIKE '%gin%' OR lines ILIKE '%gin%')")
def f2(spark, d):
    return search.search_recipes(catalog(spark, d), 'SOUR, "gin" a').select("id", "name")


@query("f3_page_of", f"SELECT id, site, name, image_url, (SELECT count(*) FROM {_CAT}) AS total FROM {_CAT} ORDER BY name NULLS LAST, id LIMIT 50 OFFSET 100")
def f3(spark, d):
    return search.page_of(parsed(spark, d), 3)


_QS = "(SELECT DISTINCT p_size AS query_id, concat(split_part(p_name, ' ', 1), CASE p_size % 3 WHEN 0 THEN ' sour' WHEN 1 THEN ' vermouth' ELSE '' END) AS q FROM (SELECT p_size, min(p_name) AS p_name FROM part GROUP BY p_size))"


@query("f4_batch_search", f"SELECT query_id, id FROM {_QS} JOIN {_CAT} c ON (contains(lower(name), split_part(q, ' ', 1)) OR contains(lower(lines), split_part(q, ' ', 1))) AND (split_part(q, ' ', 2) = '' OR contains(lower(name), split_part(q, ' ', 2)) OR contains(lower(lines), split_part(q, ' ', 2)))")
def f4(spark, d):
    A.register(spark, d)
    least = spark.table("part").groupBy("p_size").agg(F.min("p_name").alias("p_name"))
    extra = F.when(F.col("p_size") % 3 == 0, " sour").when(F.col("p_size") % 3 == 1, " vermouth").otherwise("")
    asked = least.select(F.col("p_size").alias("query_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), extra).alias("q"))
    return search.batch_search(catalog(spark, d), asked)


_QS_ID = "(SELECT p_partkey AS query_id, concat(split_part(p_name, ' ', 1), CASE p_size % 3 WHEN 0 THEN ' sour' WHEN 1 THEN ' vermouth' ELSE '' END) AS q FROM part WHERE p_partkey % 100 = 0)"


@query("f4_batch_search_by_id", f"SELECT query_id, id FROM {_QS_ID} JOIN {_CAT} c ON (contains(lower(name), split_part(q, ' ', 1)) OR contains(lower(lines), split_part(q, ' ', 1))) AND (split_part(q, ' ', 2) = '' OR contains(lower(name), split_part(q, ' ', 2)) OR contains(lower(lines), split_part(q, ' ', 2)))")
def f4_by_id(spark, d):
    """One query per part whose key is divisible by 100, so the queries grow with the table."""
    A.register(spark, d)
    extra = F.when(F.col("p_size") % 3 == 0, " sour").when(F.col("p_size") % 3 == 1, " vermouth").otherwise("")
    asked = spark.table("part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), extra).alias("q"))
    return search.batch_search(catalog(spark, d), asked)


_QS_BLANK = "(SELECT r_regionkey AS query_id, CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '(a), b' ELSE 'vermouth' END AS q FROM region)"


@query("f4_batch_search_blank", f"SELECT query_id, id FROM {_QS_BLANK} JOIN {_CAT} c ON query_id < 3 OR contains(lower(name), q) OR contains(lower(lines), q)")
def f4_blank(spark, d):
    """Some of the queries have no terms: these match the whole catalog."""
    A.register(spark, d)
    q = F.when(F.col("r_regionkey") == 0, "").when(F.col("r_regionkey") == 2, "(a), b").when(F.col("r_regionkey") > 2, "vermouth")
    return search.batch_search(catalog(spark, d), spark.table("region").select(F.col("r_regionkey").alias("query_id"), q.alias("q")))


@query("f5_page_range", "SELECT total, page, 50 AS size, CAST(ceil(total / 50) AS BIGINT) AS total_pages, CAST((page - 1) * 50 + 1 AS BIGINT) AS first_row, least(page * 50, total) AS last_row FROM (SELECT count(*) AS total, CAST(1 AS BIGINT) AS page FROM part UNION ALL SELECT count(*), 3 FROM part)")
def f5(spark, d):
    A.register(spark, d)
    total = spark.table("part").agg(F.count("*").alias("total"))
    return search.page_range(total.select("total", F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("page"), F.lit(50).alias("size")))


@query("f6_recipe_by_id", f"SELECT id, name FROM {_CAT} WHERE id = 7")
def f6(spark, d):
    return search.recipe_by_id(catalog(spark, d), 7).select("id", "name")


# ---- the same drink, and similar ones ----

_UNIT = r"\b(?:" + "|".join([*scoring.LIQUID, *scoring.DRY]) + r")\b"
_SETS = rf"""(SELECT id, trim(regexp_replace(lower(r->>'$.name'), '[^a-z0-9]+', ' ', 'g')) AS nm, list_sort(list_distinct(list_filter(list_transform(json_extract_string(r, '$.recipeIngredient[*]'),
    lambda l: trim(regexp_replace(regexp_replace(regexp_replace(lower(l), '[^a-z]+', ' ', 'g'), '{_UNIT}', ' ', 'g'), ' +', ' ', 'g'))), lambda s: s <> ''))) AS parts FROM {_RECIPES} WHERE r IS NOT NULL)"""


@query("r1_dedup_recipes", f"SELECT sha256(concat(nm, chr(10), array_to_string(parts, chr(10)))) AS dedup_key, min(id) AS id, count(*) AS n_members FROM {_SETS} GROUP BY 1")
def r1(spark, d):
    return dedup.dedup_recipes(parsed(spark, d))


@query("r2_ingredient_overlap", f"""WITH s AS (SELECT parts, min(id) AS id FROM {_SETS} GROUP BY parts), p AS (SELECT a.id, b.id AS other_id, len(list_intersect(a.parts, b.parts)) / (len(a.parts) + len(b.parts) - len(list_intersect(a.parts, b.parts))) AS jaccard FROM s a JOIN s b ON a.id <> b.id)
    SELECT id, other_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, other_id) AS rn FROM p WHERE jaccard >= 0.5) WHERE rn <= 5""")
def r2(spark, d):
    return dedup.ingredient_overlap(parsed(spark, d))


@query("r1_dedup_members", f"SELECT id, dedup_key, min(id) OVER (PARTITION BY dedup_key) AS class_id FROM (SELECT id, sha256(concat(nm, chr(10), array_to_string(parts, chr(10)))) AS dedup_key FROM {_SETS})")
def r1_members(spark, d):
    return dedup.dedup_members(parsed(spark, d))


@query("r2_overlap_members", f"SELECT id, min(id) OVER (PARTITION BY parts) AS class_id FROM {_SETS} WHERE len(parts) > 0")
def r2_members(spark, d):
    return dedup.overlap_members(parsed(spark, d))
