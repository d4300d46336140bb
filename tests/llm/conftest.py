import pytest

#: Columns that `documents` may have besides, with names that operators use themselves.
CLASHING = {"id": 1, "key": "k", "score": 0.5, "size": 3, "src": "z", "digest": "x", "taken": 9, "n": 4, "set": "s"}


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) rows, with extra columns that clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", *CLASHING.values()) for r in rows]
        schema = "doc_id long, text string, lang string, source string, id long, key string, score double, size long, src string, digest string, taken long, n long, `set` string"
        return spark.createDataFrame(full, schema)

    return make
