import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text[, lang]) tuples, with extra columns whose names clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, 7, 1.5, "x", True) for r in rows]
        return spark.createDataFrame(
            full, DOC + ", score double, token string, kept boolean").repartition(3)
    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make
