import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _k1 string, media string, id string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names clash with the operators' own. rows: (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 2, "x", "m", "i") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id"), (5, "One"), (5, "One"), (5, "another text of the same id"), (7, "é" * 300), (8, "x" * 50_000), (9, "\x00\x1f nul")]


@pytest.fixture
def edge():
    return list(EDGE)
