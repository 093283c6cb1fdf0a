import pytest

SCHEMA = "doc_id long, text string, kept boolean, score double, element long, node long, component_id long, n_chars long, html string, url string, page_id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    words = [f"w{i % 977}x{i % 31}" for i in range(60_000)]
    texts = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (2, None), (3, ""), (4, " \t\n\x0b "), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (None, None),
        (5, " ".join(words)), (6, "one"), (7, "İSTANBUL ſ Kelvinİ 漢字 🙂 password = abcdef99"), (8, "same words " * 40), (9, "same words " * 40),
    ]
    rows = [(i, t, True, 1.5, 7, 7, 7, len(t or ""), t, "http://x/\n", i) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
