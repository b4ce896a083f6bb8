import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: null and empty texts, a null id, repeated rows, a repeated id, a very long text, columns with clashing names."""
    words = [a + b for a in "abcdefgh" for b in "klmnopqr"][:60]
    long_text = " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, " ".join(words)), (2, None), (3, ""), (None, " ".join(words)), (5, " ".join(words)), (5, " ".join(words)), (5, "other text of the same id"),
            (6, long_text), (7, " \n\t\n "), (8, "日本語 テキスト é 😀 <|endoftext|>")]
    return spark.createDataFrame([(i, t, "node", 1, "kid", 2.0, True) for i, t in rows],
                                 "doc_id long, text string, node string, tk int, kid string, score double, kept boolean")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
