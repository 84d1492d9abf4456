import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (id, text) with columns whose names clash with the operators' own."""

    def make(values, id_col="doc_id", text_col="text"):
        rows = [(i, v, "x", 1, "y") for i, v in enumerate(values)]
        return spark.createDataFrame(rows, f"{id_col} long, {text_col} string, id string, n_tokens int, component string")

    return make


@pytest.fixture(scope="session")
def edge_texts():
    return [None, "", " ", "\n\t", "a", "same text", "same text", "日本語 éà", "x" * 30000, "word " * 8000, "tab\tline\nreturn\r\x0b\x0c\x1c\x85\xa0end", "a\x00b"]


@pytest.fixture(scope="session")
def by_id():
    def collect(df, key="doc_id"):
        rows = [r.asDict() for r in df.collect()]
        out = {r[key]: r for r in rows}
        assert len(out) == len(rows)
        return out

    return collect
