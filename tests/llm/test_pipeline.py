"""Every stage of the corpus pipeline against a brute-force version, each on what its predecessor kept."""

import random
import re

import corpus_pipeline
import pytest
from test_near_dup import brute
from test_text_operators import em_by_rows, features_by_words, fit_by_rows
from test_tokens_and_packing import check_pieces

from pourline.llm.decontamination import edit_stretch, normal_words
from pourline.llm.quality_model import train, votes
from pourline.llm.secret_scan import MARK

WORDS = "the and of river stone light under window carry table garden morning little friend paper bring answer season".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows = random.Random(11), []

    def prose(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "ed", "er"]) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(n)]
        return [w + "." if k % 9 == 8 else w for k, w in enumerate(words)]

    items = [" ".join(prose(n)) for n in (12, 20, 30, 40)]
    for i in range(260):
        words, kind = prose(rng.randint(40, 160)), i % 13
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + "###" for w in words]
        elif kind == 2:
            words[10:10] = rng.choice(items).split()
        elif kind == 3:
            words[5:5] = ["password", "=", "hunter" + str(i) + "xK9"]
        elif kind == 5:
            words[7:7] = ["AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(17)), "and", "".join(rng.choice("0123456789abcdef") for _ in range(26))]
        elif kind == 6:
            words[9:9] = ["passphrase:", "x7#Kp2!vQz" + str(i)]
        elif kind == 7:
            words[9:9] = ["passphrase:", "asdfghjkletmein"]
        elif kind == 4 and rows:
            words = rows[-2][1].split()
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(None, rows[20][1]), (None, "Some words that stand alone, without an id. " * 3), (30, rows[40][1]), (41, rows[41][1]), (500, None), (501, "")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages_match_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, folder)
    assert kept.columns == docs.columns
    good = rows(kept)
    # Votes of every row, EM over single rows, the fit on the different texts and the verdict, by plain loops.
    full = [t for _, t in rows(docs) if t and t.split()]
    said = ["".join("-0+"[v + 1] for v in row) for row in votes(full).tolist()]
    classes = train(docs).estimates.good
    label = {t: sum(p for p, fine in zip(x, classes, strict=True) if fine) for t, x in zip(full, em_by_rows(said, 200)[2], strict=True)}
    seen = {t: features_by_words(t) for t in label}
    weights = fit_by_rows(list(seen.values()), list(label.values()), 120)
    score = {t: sum(weights.get(f, 0.0) * v for f, v in x.items()) for t, x in seen.items()}
    assert min(map(abs, score.values())) > 1e-3
    assert good == [x for x in rows(docs) if score.get(x[1], 0) > 0]
    assert not any(re.search(r"###|!!", t) for _, t in good)
    clean = [x for x in rows(docs) if x[1] and not re.search(r"###|!!", x[1])]
    assert len(good) >= 0.98 * len(clean)

    kept = spark.createDataFrame(kept.collect(), SCHEMA)
    single = stages["minhash_near_dedup"](spark, kept, folder)
    by_row = {n: x[1] for n, x in enumerate(sorted(set(good), key=lambda x: (x[0] < 0, x[0], x[1])))}
    roots, _ = brute(list(by_row.items()), 5, 80)
    want = len(set(roots.values()))
    left = rows(single)
    assert single.columns == docs.columns and len(left) == want and set(left) <= set(good)
    at_rows, _ = brute(list(enumerate(t for _, t in left)), 5, 80)
    assert len(set(at_rows.values())) == len(left)

    single = spark.createDataFrame(single.collect(), SCHEMA)
    untouched = stages["benchmark_decontamination"](spark, single, folder)
    leaks = {x for x in left if any(edit_stretch(normal_words(i), normal_words(x[1]))[0] <= int(0.1 * len(normal_words(i))) for i in items)}
    assert rows(untouched) == [x for x in left if x not in leaks] and leaks

    untouched = spark.createDataFrame(untouched.collect(), SCHEMA)
    redacted = stages["secret_scans"](spark, untouched, folder)
    said = rows(redacted)
    base = re.compile(
        r"(?:[Pp]assword|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|x7#Kp2!vQz\d+"
    )  # the last are the planted values that cost most to guess; keyboard walks with a word are cheap
    assert said == sorted(((i, base.sub(MARK, t)) for i, t in rows(untouched)), key=lambda x: (x[0], x[1])) and any(MARK in t for _, t in said)
    before = " ".join(t for _, t in rows(untouched))
    assert all(x in before for x in ("AKIA", "x7#Kp2!vQz", "asdfghjkletmein")) and re.search(r"[0-9a-f]{26}", before)
    assert any("asdfghjkletmein" in t for _, t in said)
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.collect())

    packed = stages["best_fit_packing"](spark, redacted, folder).collect()
    check_pieces(packed, [(r["doc_id"], r["text"]) for r in redacted.collect()])


def test_the_whole_run_is_its_stages_in_turn(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    key = lambda r: (r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))
