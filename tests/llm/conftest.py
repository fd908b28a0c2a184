import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    long = " ".join(WORDS[k * k % 20] for k in range(60_000))
    plain = "Once upon a time there was a table with rows and columns in it."
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 3), (4, long, "en", "b", len(long)), (5, plain, "en", "b", len(plain)), (5, plain, "en", "b", len(plain)),
        (6, plain.replace(" ", "\n"), "en", None, 1), (None, plain, None, "c", None), (None, None, None, None, None), (7, "<|endoftext|> über Straße 日本語 ok", "de", "c", 1), (8, "x" * 5000, "de", "a", 5000), (9, "word", "", "", 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = "copy order_key kept ids n_tokens decoded n_lines n_removed keep_id group_size host sums above row node digest sig root word lang_id text_logs rate_of cut_id".split()
    return docs.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
