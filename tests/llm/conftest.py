import pytest

#: Texts with every edge that the operators define: null, empty, white space, ties, repeats, other scripts, long ones.
TEXTS = [None, "", " ", "\n\n", "one", "One TWO three four five six.", "one two three four five six.", "é ß ñ 你好 \U0001f600 \x1c\x85 \xa0x", "a" * 30000, "word " * 8000, "same text here now", "same text here now"]


@pytest.fixture
def documents(spark):
    """Documents with extra columns, some of whose names clash with those the operators make."""
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, None if t is None else len(t), "x", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, body int, n_tokens int")


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture
def folder(tmp_path):
    """Writes tables as an input folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
