import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, an extra column with a clashing name."""
    long = " ".join(f"w{i % 997}x" for i in range(40_000))
    rows = [(1, "a b c d", "x"), (2, None, "x"), (3, "", None), (None, "a b c d", "x"), (5, "é \t ü\n\nß  z", "x"), (6, long, "x"), (6, long, "x"), (7, "a b c d", "x"), (7, "other words here now", "x"), (8, " \n ", "x"), (9, "日本語のテキスト <|endoftext|> \x00 end", "x")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), c) for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
