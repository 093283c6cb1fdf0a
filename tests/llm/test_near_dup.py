import random
import re
import time

from pourline.llm.graph import connected_components
from pourline.llm.near_dup import SMALL_LIST, drop_near_duplicates, near_duplicates


def brute(rows, width, percent):
    """component of each id by comparing all sets."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_matches_brute_force_with_a_long_posting_list(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(3 * SMALL_LIST)]
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(60)) + " shared passage of many common words in a row") for i in range(100)]
    rows += [(2000 + i, "Tiny text") for i in range(3)] + [(3000, ""), (3001, None)]
    want, sizes = brute(rows, 4, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_longer_list_meet(spark, monkeypatch):
    import pourline.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 5, 9]))) for i in range(150)]
    want, _ = brute(rows, 4, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_groups_that_a_long_list_holds_are_told_apart_and_joined(spark, monkeypatch):
    """A chain of versions: the hubs reach only their own stretch, so the rest must meet in blocks of rows or of bytes."""
    import pourline.llm.near_dup as module

    monkeypatch.setattr(module, "SMALL_LIST", 8)
    monkeypatch.setattr(module, "HUBS", 1)
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 4000)
    rng = random.Random(6)
    words, rows = [f"b{i}" for i in range(200)], []
    for i in range(160):
        if i % 40:
            words[(7 * i) % 200] = f"step{i}"
        else:  # a version too far from all before it
            for k in rng.sample(range(200), 30):
                words[k] = f"jump{i}_{k}"
        rows.append(((i * 37) % 1009, " ".join(words)))
    want, _ = brute(rows, 4, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(set(want.values())) > 1 and {r["doc_id"]: r["component_id"] for r in got} == want


def shuffled_bytes(spark):
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_texts_without_a_candidate_are_not_shuffled(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(10**9)}" for _ in range(2000)) for _ in range(200)]
    rows = [*enumerate(texts), (500, texts[3] + " more"), (500, texts[4] + " more"), (501, texts[3] + " more"), (None, texts[3])]
    before = shuffled_bytes(spark)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    written = sum(v for k, v in shuffled_bytes(spark).items() if k not in before)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None and r["doc_id"] != r["component_id"]) == [(500, 3), (500, 4), (501, 3)]
    assert written < 0.5 * sum(len(t) for t in texts)


def test_a_map_of_candidates_that_is_full_loses_none(spark, monkeypatch):
    import pourline.llm.near_dup as module

    monkeypatch.setattr(module, "CANDIDATE_BITS", 1 << 15)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(words[:150] + [f"x{i // 2}y{k}" for k in range(100)] + [f"end{i}"])) for i in range(2000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = near_duplicates(odd_docs, width=4).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["kept"] and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[4]["n_shingles"] == 0
    assert by[9]["component_id"] == 8 and not by[9]["kept"] and by[6]["n_shingles"] == 1
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_duplicates(no_docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_rows_of_one_id_are_linked_each_by_its_own_text(spark):
    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words[:100]), " ".join(words[100:])
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (9, "alone in all of this"), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()) == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (9, 9)]


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 9, 1, 2), (2, text + " x", 8, 3, 4), (2, "other words here", 7, 5, 6), (3, "some more other words", 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, row_key int, __shared_id int")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2], rows[3]]


def test_rounds_of_components_leave_no_shuffle_files(spark):
    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    edges = spark.range(1, 41).selectExpr("id AS a", "id - 1 AS b")
    found = connected_components(edges, "a", "b")
    end = time.monotonic() + 20
    while (left := files() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)}
