import gzip
import json

import pytest
from pyspark.sql import functions as F

from pourline.functions.normalize import format_duration, group_steps, normalize_recipes, source_host
from pourline.operators import dedup, labels, search, state, taxonomy
from pourline.sources.files import expand_sitemap_index, read_eval_set, read_html_tree, read_sitemaps, write_html_cache


def test_queue_heals_half_evaluated_pages(spark):
    pages = spark.createDataFrame([(i, "s", f"u{i}", "Recipe", None, None if i == 4 else f"p{i}") for i in range(5)], "id long, site string, url string, status string, content_type string, html_path string")
    first, second = (spark.createDataFrame([(i,) for i in ids], "page_id long") for ids in ((0, 1), (0, 2)))
    assert [r["id"] for r in state.validate_queue(pages, first, second).collect()] == [1, 2, 3]


def _batch_of_urls(spark, n):
    """Urls in an order of their own, each twice, the later time from another site."""
    rows = spark.range(2 * n).select(F.col("id") % n, (F.col("id") >= n).alias("later")).toDF("k", "later")
    return rows.select(
        F.concat(F.lit("u"), "k").alias("url"), F.when(F.col("later"), "s2").otherwise(F.concat(F.lit("s"), F.col("k") % 2)).alias("site"),
        F.repeat(F.lit("map"), 50).alias("sitemap_source"), F.col("later").cast("int").alias("o1"), (F.col("k") * 7919 % n).alias("o2"),
    )


@pytest.fixture()
def all_ranges(spark):
    """Spark joins no small partitions, so that even a small batch has several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_new_ids_follow_the_order_of_a_batch_of_many_ranges(spark, all_ranges):
    pages = spark.createDataFrame([(41, "x")], "id long, url string")
    got = {r["url"]: (r["id"], r["site"]) for r in state.add_urls(pages, _batch_of_urls(spark, 10_007), ["o1", "o2"], "2024-01-01").collect()}
    assert got == {f"u{k}": (42 + k * 7919 % 10_007, f"s{k % 2}") for k in range(10_007)}


def test_new_urls_are_all_counted_whatever_ranges_are_joined(spark, request):
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": False, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": 16}
    for name, value in own.items():
        request.addfinalizer(lambda name=name, before=spark.conf.get(name, None): spark.conf.unset(name) if before is None else spark.conf.set(name, before))
        spark.conf.set(name, value)
    batch = _batch_of_urls(spark, 5_003).withColumn("site", F.concat("site", F.repeat(F.sha2("url", 512), 3), F.lit("/"), "site"))
    added = state.add_urls(spark.createDataFrame([(41, "x")], "id long, url string"), batch, ["o1", "o2"], "2024-01-01")
    by_site = state.new_by_site(added.withColumn("site", F.substring_index("site", "/", -1)))
    assert {tuple(r) for r in by_site.collect()} == {("s0", 2502), ("s1", 2501)}


def test_failures_go_only_when_a_page_becomes_extractable(spark):
    pages = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, content_type string")
    runs = spark.createDataFrame([(1, "no_recipe"), (2, "no_recipe"), (3, "no_recipe"), (1, "extracted")], "page_id long, outcome string")
    updates = spark.createDataFrame([(1, "confirmed_drink"), (2, "likely_junk")], "id long, new_type string")
    out, left = state.set_content_type(pages, runs, updates)
    assert {r["id"]: r["content_type"] for r in out.collect()} == {1: "confirmed_drink", 2: "likely_junk", 3: "b"}
    assert sorted((r["page_id"], r["outcome"]) for r in left.collect()) == [(1, "extracted"), (2, "no_recipe"), (3, "no_recipe")]


def test_breaker_trips_above_the_threshold_only(spark):
    rows = [(i, "nine", "blocked" if i < 9 else "Recipe") for i in range(20)] + [(i, "eight", "blocked" if i < 8 else "failed") for i in range(20)] + [(i, "short", "blocked") for i in range(19)]
    rows += [(100 + i, "eight", "pending") for i in range(50)]
    got = {r["site"]: r["paused"] for r in state.site_circuit_breaker(spark.createDataFrame(rows, "id long, site string, status string")).collect()}
    assert got == {"nine": True, "eight": False, "short": False}


def test_upsert_is_idempotent_and_unknown_tables_are_refused(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "page_id long, v string")
    once = state.upsert_latest(old, new, "page_id", [F.col("v")])
    assert sorted(map(tuple, state.upsert_latest(once, new, "page_id", [F.col("v")]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        state.clear_eval_rows("pages", old, old)


def test_labeller_without_any_label_fails(spark):
    pages = spark.createDataFrame([(1, "s", "u", None, None)], "id long, site string, url string, sitemap_source string, content_type string")
    none = spark.createDataFrame([], "page_id long, run_id long, label string, model string, prompt_version string, raw_response string, latency_ms long, evaluated_at timestamp, pages_content_type_before string")
    with pytest.raises(RuntimeError):
        labels.label_urls(pages, none, spark.createDataFrame([], "page_id long, outcome string"), lambda _: "x", "m", "v", 1, "2024-01-01")


def test_rules_see_earlier_changes_but_not_in_a_dry_run(spark):
    pages = spark.createDataFrame([(1, "foodnetwork", "https://f/VIDEOS/recipes/articles/x", "likely_drink_recipe", None)], "id long, site string, url string, content_type string, sitemap_source string")
    row, dry = labels.reclassify(pages).first(), labels.reclassify(pages, dry_run=True).first()
    assert row["new_type"] == "likely_junk" and row["fired_keys"] == ["foodnetwork_videos_junk"]
    assert dry["new_type"] == "likely_drink_recipe" and len(dry["fired_keys"]) == 2


def test_search_terms():
    assert search.search_terms('  "gin," a b% (lime) xy ') == ["gin", "lime"] and search.search_terms("   ") == [] and search.search_terms("100%") == ["100%"]
    assert search.escape_term("100%_*\\") == "100\\%\\_\\*\\\\"


def test_normalized_recipe(spark):
    recipe = {
        "name": "  ", "author": ["A", {"name": "B "}, {"x": 1}], "image": [{"url": "u"}, "u", "v"], "recipeYield": 2.0, "prepTime": "PT1H30M", "cookTime": "PT0M", "totalTime": "PT2H",
        "ingredients": "a\n\n b ", "recipeInstructions": ["s1", {"text": " s2 "}, {"@type": "HowToSection", "itemListElement": ["x", {"text": "y"}]}, {"@type": "HowToSection", "name": "empty"}, "s3"],
    }
    rows = spark.createDataFrame([(json.dumps(recipe),), ("not json",)], "jsonld string")
    got = normalize_recipes(rows).withColumn("groups", group_steps(F.col("normalized.instructions"))).collect()
    n = got[0]["normalized"]
    assert (n["name"], n["author"], n["images"], n["yield"], n["prep_time"], n["cook_time"], n["total_time"], n["ingredients"]) == ("Untitled", "A & B", ["u", "v"], "2", "1 h 30 min", None, "2 h", ["a", "b"])
    assert [(x["kind"], x["text"], x["heading"], x["steps"]) for x in n["instructions"]] == [("step", "s1", None, None), ("step", "s2", None, None), ("section", None, "", ["x", "y"]), ("step", "s3", None, None)]
    assert [(g["kind"], g["steps"]) for g in got[0]["groups"]] == [("steps", ["s1", "s2"]), ("section", ["x", "y"]), ("steps", ["s3"])] and got[1]["normalized"] is None
    row = spark.createDataFrame([("PT90M", "https://A.com:8080/x"), ("PT5S", "nope")], "d string, u string").select(format_duration(F.col("d")), source_host(F.col("u"))).collect()
    assert [tuple(r) for r in row] == [("90 min", "a.com:8080"), (None, "source")]


def test_taxonomy_constraints(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "b", "brand"), (3, "b", "odd")], "id long, slug string, role string")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "parent_id long, child_id long")
    aliases = spark.createDataFrame([("x", 1)], "alias string, node_id long")
    assert sorted(r["rule"] for r in taxonomy.violations(nodes, edges, aliases).collect()) == ["edge is not unique", "edge to itself", "slug is not unique", "unknown role"]


def test_sources(spark, tmp_path):
    site = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>'
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.xml").write_text(site)
    with gzip.open(tmp_path / "m" / "two.xml.gz", "wt") as f:
        f.write(site)
    got = {(r["url"], r["sitemap_source"]) for r in read_sitemaps(spark, str(tmp_path / "m"), "s").collect()}
    assert got == {(f"http://a/{k}", f"{n}") for k in (1, 2) for n in ("one.xml", "two.xml.gz")}
    index = "<sitemapindex><sitemap><loc>d1</loc></sitemap><sitemap><loc>bad</loc></sitemap><sitemap><loc>root</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([("root", index), ("d1", site), ("bad", "<urlset><url>"), ("page", "<html>")], "url string, xml string")
    assert {(r["url"], r["sitemap_source"]) for r in expand_sitemap_index(docs, spark.createDataFrame([("root",)], "url string")).collect()} == {("http://a/1", "d1"), ("http://a/2", "d1")}
    (tmp_path / "e.jsonl").write_text('{"url": "u", "expected": "x"}\n\n{"url": "v", "expected": "y"}\n')
    assert read_eval_set(spark, str(tmp_path / "e.jsonl"), "url string, expected string").where("url IS NOT NULL").count() == 2
    (tmp_path / "t" / "site").mkdir(parents=True)
    (tmp_path / "t" / "site" / "ab.html").write_text("é")
    assert [tuple(r) for r in read_html_tree(spark, str(tmp_path / "t")).collect()] == [("site/ab.html", "é")]
    write_html_cache(spark.createDataFrame([("s", "u", "s/x.html", "h")], "site string, url string, html_path string, html string"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_every_recipe_has_its_class(spark):
    rows = [(1, "Gin Sour", ["2 oz gin", "lemon"]), (2, "gin  sour", ["1 oz gin", "lemon"]), (3, "Other", ["lemon", "gin"]), (4, "Bare", [])]
    recipes = spark.createDataFrame(rows, "id long, name string, ingredients array<string>")
    found = {r["id"]: r for r in dedup.dedup_members(recipes).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and found[1]["dedup_key"] == found[2]["dedup_key"]
    assert sorted(map(tuple, dedup.overlap_members(recipes).collect())) == [(1, 1), (2, 1), (3, 1)]


def test_repeated_updates_and_results_keep_one_row_a_page(spark):
    from pourline.operators.state import apply_fetch_results, set_content_type

    pages = spark.createDataFrame([(1, "u1", "pending", None, 0, None, None, None), (2, "u2", "pending", None, 1, None, None, None)], "id long, url string, status string, content_type string, attempts int, fetch_error string, html_path string, fetched_at timestamp")
    runs = spark.createDataFrame([(1, "no_recipe")], "page_id long, outcome string")
    out, left = set_content_type(pages, runs, spark.createDataFrame([(1, "food"), (1, "drink_recipe"), (1, "food")], "id long, new_type string"))
    assert sorted((r["id"], r["content_type"]) for r in out.collect()) == [(1, "food"), (2, None)]
    results = spark.createDataFrame([("u1", None, "Recipe", "a"), ("u1", "late", None, None), ("u2", "e1", None, None), ("u2", "e2", None, None)], "url string, error string, new_status string, new_path string")
    got = {r["id"]: (r["status"], r["attempts"], r["fetch_error"], r["html_path"]) for r in apply_fetch_results(pages, results, "2026-01-01").collect()}
    assert got == {1: ("Recipe", 1, "late", "a"), 2: ("failed", 3, "e2", None)}


def test_deep_sitemaps_and_taxonomies_are_followed_to_the_end(spark):
    from pourline.operators.taxonomy import taxonomy_closure
    from pourline.sources.files import expand_sitemap_index

    docs = [(f"s{i}", f"<sitemapindex><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>") for i in range(13)] + [("s13", "<urlset><url><loc>page</loc></url></urlset>")]
    found = expand_sitemap_index(spark.createDataFrame(docs, "url string, xml string"), spark.createDataFrame([("s0",)], "url string"))
    assert [tuple(r) for r in found.collect()] == [("page", "s13")]
    closure = taxonomy_closure(spark.createDataFrame([(i, i + 1) for i in range(12)], "parent_id long, child_id long"))
    assert closure.count() == 12 * 13 // 2
