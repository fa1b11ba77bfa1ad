import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of sf0.001 as ``{doc_id: text}``."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with internal-looking names."""
    long = " ".join(f"word{i} and more" for i in range(20_000))
    rows = [(1, None, "en"), (2, "", "en"), (None, "no id here at all", None), (4, long, "en"), (5, "same text twice\n" * 3, "de"), (5, "same text twice\n" * 3, "de"), (6, None, None), (7, "\n\n \t\n", "fr")]
    df = spark.createDataFrame(rows, DOC)
    for name in ("h1", "h2", "batch", "root", "row_hash", "token", "k", "sketch", "anchor", "bits", "length", "rank"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
