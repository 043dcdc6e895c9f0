import pytest

LONG = "Ab  cd, é " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"),
        (1, "the cat sat on the mat and looked at the dog", "en", "a"),
        (2, "The CAT sat on the mat and looked at the dog", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, "one two three", "en", "a"),
        (5, "one two three", "en", "b"),
        (6, "\n \t ", "en", "b"),
        (7, LONG, "fr", "a"),
        (8, "\x00 <|endoftext|> <s> \u2581 日本語 😀", "ja", "c"),
    ]
    schema = "doc_id bigint, text string, lang string, source string"
    from pyspark.sql import functions as F

    extra = {
        c: F.lit(7) for c in (
            "id", "node", "bands", "label", "key", "block", "tokens", "epochs", "mix_epoch", "keep", "a", "ids",
            "n_tokens", "bucket", "next", "held", "kept"
        )
    }
    return spark.createDataFrame(rows, schema).withColumns(extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
