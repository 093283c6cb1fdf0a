"""Tables at rest: merges rewrite what changed, a bucketed cache is not shuffled, indexes answer as a scan does."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pourline.operators import dedup, labels, search, taxonomy
from pourline.operators.extraction import extract_recipes
from pourline.operators.search_index import SearchIndex
from pourline.operators.stored import KeyedTable, merge_recipes
from pourline.operators.validation import evaluate, join_html_cache, page_type
from pourline.streaming.frontier import UrlFrontier
from pourline.sources.files import expand_sitemap_index, write_bucketed_cache


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_the_buckets_that_change_and_a_repeated_one_none(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), "k", "k long, v string, n int", 8)
    assert table.rows(spark).count() == 0
    rows = spark.range(800).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("n"))
    assert table.merge(rows, [F.col("n")]) == list(range(8))
    before = files(table.path)
    some = rows.withColumn("bucket", table.bucket()).where("bucket = 3").drop("bucket").limit(8)
    updates = some.withColumn("v", F.lit("b")).unionByName(some.withColumns({"v": F.lit("late"), "n": F.lit(2)}))
    assert table.merge(updates, [F.desc("n")]) == [3]
    after = files(table.path)
    assert {f for f in before ^ after if "bucket=3" not in f} == set() and before != after
    assert table.rows(spark).groupBy("v", "n").count().collect().__len__() == 2
    assert table.rows(spark).where("v = 'late' AND n = 2").count() == 8 and table.rows(spark).count() == 800
    assert table.merge(updates, [F.desc("n")]) == [] and files(table.path) == after
    assert {r["k"] for r in table.of(spark, some.select("k")).collect()} == {r["k"] for r in some.collect()}
    none = updates.withColumn("k", F.lit(None).cast("long"))
    assert table.merge(none, [F.col("n")]) == [] and table.merge(updates.limit(0), [F.col("n")]) == []


def test_stored_recipes_keep_their_ids(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "r"), "source_url", "id long, source_url string, name string, jsonld string, fetched_at timestamp, extracted_at timestamp", 4)
    new = lambda *rows: spark.createDataFrame([(*r, "{}") for r in rows], "source_url string, name string, jsonld string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    assert merge_recipes(table, new(("u1", "a"), ("u2", "b")), "2024-01-01")
    ids = {r["source_url"]: r["id"] for r in table.rows(spark).collect()}
    assert merge_recipes(table, new(("u1", "a")), "2024-02-01") == []
    assert len(merge_recipes(table, new(("u1", "c"), ("u3", "d")), "2024-02-01")) >= 1
    got = {r["source_url"]: r for r in table.rows(spark).collect()}
    assert {u: got[u]["id"] for u in ids} == ids and got["u1"]["name"] == "c"
    assert [got[u]["extracted_at"].month for u in ("u1", "u2", "u3")] == [2, 1, 2]


def exchanges_with(df, name):
    """Exchanges whose rows have the column, by the nodes' own output lists."""
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStage" in kind:
            return walk(node.plan())
        if "Exchange" in kind and name in node.output().mkString(","):
            found.append(kind)
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_html_is_not_shuffled(spark, request, bound):
    pages = spark.range(400).select(F.concat(F.lit("s/"), "id").alias("html_path"), F.concat(F.lit("<p>"), "id").alias("html"))
    write_bucketed_cache(pages, f"cache_{bound}", 8)
    queue = spark.range(0, 500, 3).select("id", F.concat(F.lit("s/"), "id").alias("html_path"))
    joined = join_html_cache(queue, spark.table(f"cache_{bound}"), bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the few pages of this test are not sent as a whole either
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    assert exchanges_with(joined, "html#") == []
    got = {r["id"]: r["html"] for r in joined.collect()}
    assert got == {k: f"<p>{k}" if k < 400 else None for k in range(0, 500, 3)}


def test_the_stored_index_answers_as_a_scan(spark, tmp_path):
    rng = random.Random(6)
    words = ["gin", "ginger", "sour", "Negroni", "lime", "a%b_c", "ice", "éclair", "sugar"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    rows = {k: (text(), text() if k % 5 else None) for k in range(120)}
    frame = lambda kept: spark.createDataFrame([(k, *kept[k]) for k in kept], "id long, name string, ingredients_json string")
    index = SearchIndex(str(tmp_path / "index"), 3, 4)
    index.upsert(frame(rows), 1)
    changed = {k: (text(), text()) for k in [*range(0, 60, 4), *range(120, 140)]}
    index.upsert(frame(changed | {1: rows[1]}), 2)
    index.upsert(frame(changed), 2)  # made again
    rows |= changed
    asked = ["gin", "GINGER", "gin sour", "a%b", "xyz", "", "éclair", "in", "ice lime sugar", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    want = set()
    for n, q in enumerate(asked):
        terms = [t.lower() for t in search.search_terms(q or "")]
        want |= {(n, k) for k, (name, lines) in rows.items() if all(t in (name or "").lower() or t in (lines or "").lower() for t in terms)}
    assert {tuple(r) for r in index.search(queries).collect()} == want
    index.compact(spark)
    assert sorted(tuple(r) for r in index.search(queries).collect()) == sorted(want)


def test_lists_stay_short_and_equal_queries_ask_once(spark, tmp_path, monkeypatch):
    from pourline.operators import search_index

    monkeypatch.setattr(search_index, "LIST", 5, raising=False)
    index = SearchIndex(str(tmp_path / "index"), 3, 4)
    rows = spark.range(300).select("id", F.concat(F.lit("gin "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("ingredients_json"))
    index.upsert(rows, 1)
    index.upsert(rows.where("id < 30").withColumn("name", F.lit("sour")), 2)
    assert index.postings(spark).agg(F.max("n")).first()[0] <= 20
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.when(F.col("id") < 39, "gin").otherwise("sour Sour").alias("q"))
    want = [(q, k) for q in range(39) for k in range(30, 300)] + [(39, k) for k in range(30)]
    assert sorted(tuple(r) for r in index.search(queries).collect()) == want
    index.compact(spark)
    assert index.postings(spark).agg(F.max("n")).first()[0] <= 20


@pytest.mark.parametrize("bytes_at_once", [8 << 20, 400])
def test_a_batch_search_shuffles_no_text(spark, monkeypatch, request, bytes_at_once):
    """Terms that are too many for one part go to the tasks in several."""
    monkeypatch.setattr(search, "SENT_BYTES", bytes_at_once, raising=False)
    rng = random.Random(3)
    words = ["gin", "ginger", "sour", "Negroni", "lime", "a%b_c", "ice", "éclair", "sugar", "vermouth"]
    rows = {k: (" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), " ".join(rng.choice(words) for _ in range(3)) if k % 5 else None) for k in range(200)}
    asked = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(30)] + ["gin", "GIN", "xyz", "", None, "in"]
    recipes = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, name string, ingredients_json string")
    found = search.batch_search(recipes, spark.createDataFrame(list(enumerate(asked)), "query_id int, q string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    assert exchanges_with(found, "name#") == exchanges_with(found, "ingredients_json#") == []
    want = set()
    for n, q in enumerate(asked):
        terms = [t.lower() for t in search.search_terms(q or "")]
        want |= {(n, k) for k, (name, lines) in rows.items() if all(t in name.lower() or t in (lines or "").lower() for t in terms)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_pages_of_the_stored_order(spark, tmp_path):
    rows = spark.range(230).select("id", F.lit("s").alias("site"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 50)).alias("name"), F.lit("i").alias("image_url"))
    path = str(tmp_path / "pages")
    search.write_page_index(rows, path, 5)
    for page in (1, 2, 12, 23, 24, 99):
        got = [tuple(r) for r in search.stored_page(spark, path, page, 10).collect()]
        assert got == [tuple(r) for r in search.page_of(rows, page, 10).collect()]
    plan = search.stored_page(spark, path, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range#\d+ = 0", plan)


def test_cycles_are_the_strong_components(spark):
    rng = random.Random(9)
    for n, m in ((12, 14), (30, 45)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(n, n), (n, n + 1), (n + 2, n + 3), (n + 3, n + 2)}
        reach = {v: {b for a, b in edges if a == v} for v in range(n + 4)}
        for _ in range(n + 4):
            for v in reach:
                reach[v] |= set().union(*(reach[u] for u in reach[v]))
        want = set()
        for v in reach:
            if v in reach[v]:
                own = {u for u in reach[v] if v in reach[u]}
                want.add((v, min(own), len(own)))
        df = spark.createDataFrame([*edges, (None, 3)], "parent_id long, child_id long")
        assert {tuple(r) for r in taxonomy.cyclic_nodes(df).collect()} == want
    assert taxonomy.cyclic_nodes(spark.createDataFrame([], "parent_id long, child_id long")).count() == 0


@pytest.mark.parametrize("list_rows", [2000, 7])
def test_similar_sets_lose_no_pair(spark, list_rows):
    rng = random.Random(12)
    sets = {k: sorted({"hot", *(f"p{int(rng.random() ** 3 * 40)}" for _ in range(rng.randint(0, 7)))}) for k in range(150)}
    df = spark.createDataFrame(list(sets.items()), "id long, parts array<string>")
    got = {(r["id"], r["other_id"]): r["jaccard"] for r in dedup.similar_sets(df, 0.6, list_rows).collect()}
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b): score(sets[a], sets[b]) for a in sets for b in sets if a < b and score(sets[a], sets[b]) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize(("jaccard", "longest"), [(0.5, 24), (0.6, 7), (0.25, 12)])
def test_the_most_similar_sets_are_those_of_all_pairs(spark, monkeypatch, jaccard, longest):
    """Sets of one part up to long ones, and many equal ones, which are compared once."""
    rng = random.Random(longest)
    some = [rng.sample(range(30), rng.randint(1, longest)) for _ in range(60)]
    some += [rng.sample(s, max(1, len(s) - rng.randint(0, 2))) + [40] * rng.randint(0, 1) for s in some for _ in range(2)]
    sets = dict(enumerate([rng.sample(s, len(s)) for s in some + some[:40] + [[1, 2, 3]] * 90]))
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, *x) for a in sets for x in sorted(((b, score(sets[a], sets[b])) for b in sets if b != a and score(sets[a], sets[b]) >= jaccard), key=lambda x: (-x[1], x[0]))[:3]}
    made, join = [], dedup.similar_sets
    monkeypatch.setattr(dedup, "similar_sets", lambda *args: made.append(join(*args)) or made[-1])
    df = spark.createDataFrame(list(sets.items()), "id long, parts array<int>")
    got = {tuple(r) for r in dedup.most_similar(df, 3, jaccard).collect()}
    assert {(a, b, round(j, 9)) for a, b, j in got} == {(a, b, round(j, 9)) for a, b, j in want}
    first = {}
    for a, s in sets.items():
        first.setdefault(frozenset(s), a)
    assert {r["id"] for r in made[0].collect()} | {r["other_id"] for r in made[0].collect()} <= set(first.values())


def _labels(spark, labeller, urls=("u1", "u2", "bad")):
    pages = spark.createDataFrame([(k, "s", u, None, None) for k, u in enumerate(urls)], "id long, site string, url string, sitemap_source string, content_type string")
    none = spark.createDataFrame([], "page_id long, run_id long, label string, model string, prompt_version string, raw_response string, latency_ms long, evaluated_at timestamp, pages_content_type_before string")
    return labels.label_urls(pages, none, spark.createDataFrame([], "page_id long, outcome string"), labeller, "m", "v", 1, "2024-01-01")


def test_a_labeller_that_raises_stops_no_other_row(spark):
    def labeller(message):
        if "bad" in message:
            raise ValueError("no")
        return '{"label": "likely_junk"}'

    pages, runs, _, asked = _labels(spark, labeller)
    assert {r["id"]: r["content_type"] for r in pages.collect()} == {0: "likely_junk", 1: "likely_junk", 2: None}
    assert {r["id"]: r["error"] for r in asked.collect()} == {0: None, 1: None, 2: "ValueError: no"}
    assert runs.where("latency_ms >= 0").count() == 2
    with pytest.raises(RuntimeError, match="ValueError: no"):
        _labels(spark, labeller, ("bad1", "bad2"))


def test_malformed_sitemaps_add_nothing_and_stop_nothing(spark):
    head, ns = '<?xml version="1.0"?>', 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    page = lambda loc: f"{head}<urlset {ns}><url><loc>{loc}</loc></url></urlset>"
    docs = {
        "ok": page(" https://a/1 "), "amp": page("https://a/?x=1&y=2"), "nbsp": page("https://a/&nbsp;"), "comment": page("https://a/2") + "<!-- end -->", "escaped": page("https://a/?x=1&amp;y=2"),
        "entity": f'{head}<!DOCTYPE u [<!ENTITY e "https://evil/">]><urlset><url><loc>&e;</loc></url></urlset>', "cut": page("https://a/3")[:-5], "null": None, "empty": "", "html": "<html></html>",
        "prefix": f'{head}<m:urlset xmlns:m="x"><m:url><m:loc>https://a/4</m:loc></m:url></m:urlset>',
    }
    docs["root"] = "<sitemapindex>" + "".join(f"<sitemap><loc>{k}</loc></sitemap>" for k in [*docs, "gone", "root"]) + "</sitemapindex>"
    frame = spark.createDataFrame(list(docs.items()), "url string, xml string")
    got = {tuple(r) for r in expand_sitemap_index(frame, frame.where("url = 'root'").select("url")).collect()}
    assert got == {("https://a/1", "ok"), ("https://a/2", "comment"), ("https://a/?x=1&y=2", "escaped"), ("https://a/4", "prefix")}


def test_an_empty_type_is_none(spark):
    rows = spark.createDataFrame([(("", "Recipe"),), (("", None),), (("WebPage", ""),)], "facts struct<jsonld_type:string,microdata_type:string>")
    assert [r[0] for r in rows.select(page_type(F.col("facts"))[0]).collect()] == ["Recipe", None, "WebPage"]


def test_extraction_parses_a_page_once(spark):
    pages = spark.createDataFrame([(1, "s", "u", "confirmed_drink", "s/1.html")], "id long, site string, url string, content_type string, html_path string")
    cache = spark.createDataFrame([("s/1.html", "<p>x</p>")], "html_path string, html string")
    runs = spark.createDataFrame([], "page_id long, run_id long, outcome string, error string, extractor_version string, evaluated_at timestamp")
    recipes = spark.createDataFrame([], "id long, source_url string, site string, name string, author string, image_url string, jsonld string, fetched_at timestamp, extracted_at timestamp")
    out = extract_recipes(pages, cache, runs, recipes, 1, "2024-01-01")
    for name in ("outcomes", "extract_runs", "recipes", "new_recipes"):
        assert "ArrowEvalPython" not in out[name]._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in evaluate(cache.withColumn("url", F.lit("u")))._jdf.queryExecution().executedPlan().toString()


def test_a_frontier_reads_only_buckets_that_may_hold_a_url(spark, tmp_path):
    frontier = UrlFrontier(str(tmp_path / "f"), 8, 1 << 14)
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("s").alias("site"))
    assert frontier.add(urls(0, 300).unionByName(urls(0, 40))) == []
    assert frontier.read(spark).count() == 300
    home = {r["url"]: r["bucket"] for r in frontier.read(spark).collect()}
    assert frontier.add(urls(300, 340)) in ([], *([b] for b in range(8)))  # a filter of some 40 urls hardly errs
    assert frontier.add(urls(7, 8).unionByName(urls(400, 402))) == [home["u7"]]
    assert frontier.add(urls(0, 340)) == list(range(8))  # made again: nothing is added
    assert frontier.add(spark.createDataFrame([(None, "s")], "url string, site string")) == []
    got = [r["url"] for r in frontier.read(spark).collect()]
    assert len(got) == len(set(got)) == 342
