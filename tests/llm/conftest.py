import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from texts; ids are positions, and a column clashes with usual helper names."""
    def build(texts):
        rows = [(i, text, "en", "s", len(text or ""), i) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")

    return build


@pytest.fixture(scope="session")
def sf():
    return SF
