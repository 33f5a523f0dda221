import pytest

#: Columns whose names the operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, gram long, found string, label int"


@pytest.fixture(autouse=True)
def shipped(spark):
    from procatlas.llm.shared import ship

    ship(spark)


@pytest.fixture
def documents(spark):
    """Build documents from (doc_id, text) pairs, with clashing extra columns."""

    def build(rows, parts=3):
        full = [(i, t, None, "s", None if t is None else len(t), 0.5, 1, 2, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, EXTRA).repartition(parts) if full else spark.createDataFrame([], EXTRA)

    return build
