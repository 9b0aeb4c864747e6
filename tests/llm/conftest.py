import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, extra columns of odd names."""
    long = " ".join(f"word{i % 977} the and" for i in range(30_000)) + "\nlast line"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 64),
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 64),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", None, None, None),
        (3, None, "en", "a", 5),
        (4, "", "en", "b", 0),
        (5, " \t\n\x0b ", "en", "b", 5),
        (None, "no id at all", "en", "c", 12),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, "1234 5678 !!! ???", "en", "b", 17),
        (8, "naïve café \U0001f600 你好 ﬁne İstanbul ΣΑΣ <|endoftext|> é", "fr", "c", 60),
        (9, "one", "en", "c", 3),
    ]
    names = ["score", "fp", "h", "n", "key", "line", "lines", "dedup", "epoch", "epochs", "site", "order", "count", "text_hash", "doc_key", "gone", "quality", "toxic", "bucket", "root"]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
