"""One local session; the edge rows that every document operator must take."""

import pytest

from simforge.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) pairs of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, start int, n int, label string, h string"


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, null columns, a long text, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 700} x{i}" for i in range(20_000))
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z\none\ntwo\nthree\nfour"
    texts = [None, "", " \t\n ", "one", "one", same, same, same + "\nfive six", long, long + " tail", "é ü ß 💡 end " * 30, "the " * 400]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 4 else None, len(t) if t else None, 7, 1, 2, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, same, None, None, None, None, None, None, None, None), (5, "another text of the same id " * 12, "en", "s1", 3, 1, 1, 1, "y", "z")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
