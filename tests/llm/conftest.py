import pytest

DOCS = "doc_id long, text string, source string, size long, shard int, kept boolean, n_words string"


@pytest.fixture
def docs(spark):
    """Documents out of (doc_id, text[, source]), with extra columns whose names operators use."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", -1, -1, None, "x") for r in rows], DOCS)

    return make


def words(start, n):
    return " ".join(f"w{i}" for i in range(start, start + n))
