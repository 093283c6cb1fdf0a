import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pourline.llm.packing import _greedy, heaviest, pack, pack_histogram, solve
from pourline.llm.queries import tokenizer
from pourline.llm.token_files import token_files
from pourline.llm.tokens import Encoder

KINDS = (("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "lead"))


@pytest.mark.parametrize(("name", "cut"), KINDS)
def test_runs_give_the_tokenizers_own_ids(name, cut):
    rng = random.Random(5)
    letters = list("abcXYZ  \n\t'’sdtrevml0159²½ªº_.,!?-éÀßñÑçØ\x1c\x85\xa0 ́ΣςİKſ漢字🙂|%&<>")
    parts = ["it's", "don't ", " 'sam", "  two", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\n\n", "x² 5", "the ", "ÉTÉ", "_a_", "1234", "'ll've", "''s", "\n'd", "“q”", "…"]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcXYZ  \n\t.,!?0159_-éÀßñ|%&\r'strevmld") for _ in range(30)) for _ in range(4000)] + ["", "x" * 5000]
    plain = Tokenizer.from_file(tokenizer(name))
    want = [[*e.ids, 7] for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(tokenizer(name), cut, most=500)  # forgets several times
    for _ in range(2):
        for at in range(0, len(texts), 700):
            ids, bounds = encoder(texts[at : at + 700], 7)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want[at : at + 700]
    assert encoder([], 7)[0].tolist() == []


def test_the_heaviest_pattern_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        limits, weights = rng.integers(0, 4, capacity + 1), rng.random(capacity + 1)
        limits[0] = 0
        limits[1 : 1 + int(rng.integers(0, 4))] = 50
        best = np.zeros(capacity + 1)
        for length in range(1, capacity + 1):
            for _ in range(min(int(limits[length]), capacity // length)):
                best[length:] = np.maximum(best[length:], best[: capacity + 1 - length] + weights[length])
        found = heaviest(weights, limits, capacity)
        assert (found <= limits).all() and found @ np.arange(capacity + 1) <= capacity and found @ weights == pytest.approx(best[-1])


def best_fit_alone(counts, capacity):
    left, n = counts.copy(), 0
    while left.any():
        pattern = _greedy(left, capacity)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        n += times
    return n


def test_the_program_beats_best_fit_where_best_fit_is_poor():
    counts = np.zeros(2049, np.int64)
    for length, n in ((1064, 600), (592, 600), (552, 600), (432, 1200)):
        counts[length] = n
    uses, bound = solve(counts, 2048)
    assert bound == pytest.approx(900) and sum(x for _, x in uses) <= 1.001 * bound
    assert best_fit_alone(counts, 2048) == 1100 and sum(n for _, n in pack_histogram(counts, 2048)) == 900
    thirds = np.bincount(np.random.default_rng(1).integers(600, 760, 6000), minlength=2049)
    uses, bound = solve(thirds, 2048)
    packed = sum(n for _, n in pack_histogram(thirds, 2048))
    assert packed <= 1.02 * bound and best_fit_alone(thirds, 2048) >= 1.08 * packed


@pytest.mark.parametrize("kind", ["logs", "wide", "few"])
def test_the_fractional_solution_is_feasible_and_near_its_bound(kind):
    rng = np.random.default_rng(1)
    lengths = {"logs": np.clip(rng.lognormal(6, 1, 4000), 1, 2047), "wide": rng.integers(1, 2048, 800), "few": np.array([2000, 40, 8, 8])}[kind]
    counts = np.bincount(lengths.astype(int), minlength=2049)
    uses, bound = solve(counts, 2048)
    assert (sum(p * x for p, x in uses) >= counts * (1 - 1e-6)).all()
    packed = sum(n for _, n in pack_histogram(counts, 2048))
    assert bound <= packed <= best_fit_alone(counts, 2048) and packed <= 1.01 * bound + 1


@pytest.mark.parametrize("kind", ["logs", "wide", "few", "whole", "none"])
def test_histogram_is_packed_whole_and_tightly(kind):
    rng = np.random.default_rng(1)
    lengths = {"logs": np.clip(rng.lognormal(6, 1, 4000), 1, 2048), "wide": rng.integers(1, 2049, 3000), "few": np.array([2000, 40, 8, 8]), "whole": np.full(7, 2048), "none": np.array([])}[kind]
    counts = np.bincount(lengths.astype(int), minlength=2049)
    plan = pack_histogram(counts, 2048)
    assert (sum((p * n for p, n in plan), np.zeros(2049, int)) == counts).all()
    assert all((p * np.arange(2049)).sum() <= 2048 for p, _ in plan)
    least = max(-(-int((counts * np.arange(2049)).sum()) // 2048), int(counts[1025:].sum()))
    assert sum(n for _, n in plan) <= 1.02 * least + 1


def check_pieces(rows, docs, name="word_bpe_49k.json"):
    plain = Tokenizer.from_file(tokenizer(name))
    want = []
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    key = lambda x: (x[0] is not None, x)
    assert sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, x[1:])), key
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack_odd_rows(odd_docs, no_docs):
    check_pieces(pack(odd_docs, tokenizer("word_bpe_49k.json")).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert pack(no_docs, tokenizer("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(spark, odd_docs, no_docs):
    path = tokenizer("byte_bpe_50k.json")
    rows = token_files(spark, odd_docs, path, "lead", 2).collect()
    plain = Tokenizer.from_file(path)
    want = sorted((len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect()))
    assert sorted(r["n_tokens"] for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    by = {r["doc_id"]: r for r in rows}
    for r in odd_docs.where("doc_id > 1").collect():
        assert by[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert token_files(spark, no_docs, path, "lead", 2).count() == 0


def test_special_tokens_in_a_text_are_the_tokenizers_own(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "a <|startoftext|>b"), (3, "plain 'text' it's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(pack(docs, tokenizer("word_bpe_49k.json")).collect(), rows)
    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files(spark, docs, tokenizer("byte_bpe_50k.json"), "lead", 2).collect()}
    assert got == {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}
