import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pourline.llm.align import Memory, Pair, align_tokenizers, cut_units
from pourline.llm.perfect_hash import PerfectHash
from pourline.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def both():
    return Pair(tokenizer(A), tokenizer(B))


def plain(both, text):
    """(A ids, B ids, groups, links) of one text by plain loops; None without tokens."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    spans = []
    for ids, known in ((a, both.bytes_a), (b, both.bytes_b)):
        if b"".join(known[i] for i in ids) != raw:
            return None
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(known[i]), i))
            at += len(known[i])
        spans.append(own)
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for s, e, i in own if start < e <= end) for own in spans))
        start = end
    return a, b, groups, links


def brute(both, rows):
    found = [(i, plain(both, t)) for i, t in rows]
    count = Counter(pair for _, x in found if x for pair in set(x[3]))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_agree_with_plain_loops(spark, both):
    rng = random.Random(11)
    parts = ["the", "Cocktail", " ", "  ", "\n", "\t", " \n ", "don't", "it's", "<s>", "</s>", "<|endoftext|>", "▁", "漢字", "é", "ﬁ", "🙂", "1234", "...", "\x1c", "\x85", "　", "ſ", "x" * 70, "<0x41>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(250)]
    texts += ["plain words in a row " * 5] * 40 + [None, "", " ", "▁", "a ", " a"]
    rows = [(n if n % 7 else None, t) for n, t in enumerate(texts)] + [(5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(align_tokenizers(docs, tokenizer(A), tokenizer(B), bucket_pairs=64)) == brute(both, rows)


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    out = align_tokenizers(odd_docs, tokenizer(A), tokenizer(B)).collect()
    assert len(out) == odd_docs.count() and {r["n_a"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert align_tokenizers(no_docs, tokenizer(A), tokenizer(B)).collect() == []


def test_units_join_to_the_text_and_its_tokens(both):
    rng = random.Random(4)
    for _ in range(800):
        text = "".join(rng.choice("ab \n\t　\x1c'sé1.") for _ in range(rng.randint(1, 20)))
        units = cut_units(text)
        assert "".join(units) == " " + text
        a, b = both.ids(units)
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == both.b.encode(text)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        hashed = PerfectHash.build(keys)
        assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
        assert len(hashed.bits) < 4 * len(keys) + 16


def test_a_small_memory_forgets_and_still_aligns(both):
    rng = random.Random(9)
    memory = Memory(both, most=12)
    for _ in range(120):
        texts = [" ".join(rng.choice(["gin", "sour", "x" * 80, f"w{rng.randrange(300)}", "it's"]) for _ in range(rng.randint(1, 6))) for _ in range(3)]
        flat, places, counts = memory([cut_units(t) for t in texts])
        at = 0
        start = np.cumsum(flat.n_links) - flat.n_links
        for text, n in zip(texts, counts.tolist(), strict=True):
            own = places[at : at + n].tolist()
            at += n
            a, b, groups, links = plain(both, text)
            assert ";".join(flat.groups[k] for k in own) == ";".join(groups)
            found = [p for k in own for p in memory.pairs[flat.codes[start[k] : start[k] + flat.n_links[k]]].tolist()]
            assert found == [(i << 32) | j for i, j in links]
        assert memory.size <= 12 + 18
