import hashlib
import random
import re
from collections import defaultdict

from pourline.llm.exact_dup import ContentTable, exact_duplicates, normalised

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row, by one dictionary."""
    groups = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, n))
    out = []
    for content, held in groups.items():
        best = min(held)
        for _, none, i, n in held:
            out.append((None if none else i, None if best[1] else best[2], len(held), n == best[3], hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_every_row_has_its_group(spark, odd_docs, no_docs):
    assert got(exact_duplicates(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert got(exact_duplicates(no_docs)) == []


def test_tables_that_hold_little_spill_until_all_is_settled(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(400), "".join(rng.choice("ab \n 　é") for _ in range(rng.randint(0, 9)))) for _ in range(1500)]
    rows += [(n, "a hot text\t" + " " * (n % 3)) for n in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for table_bytes, fan_out in ((120, 8), (1 << 20, 1)):
        assert got(exact_duplicates(docs, table_bytes=table_bytes, fan_out=fan_out)) == want


def test_equal_digests_do_not_make_texts_equal():
    table = ContentTable()
    numbers = [table.find(7, str(n).encode(), True) for n in range(5000)]
    assert numbers == list(range(5000))
    assert [table.find(7, str(n).encode(), False) for n in (0, 4999, 5000)] == [0, 4999, -1]


def test_white_space_is_six_characters_only():
    assert normalised(" a\t\n\x0b\x0c\rb\x1c\xa0 ") == "ab\x1c\xa0 ".encode()
    assert normalised(None) == b""
