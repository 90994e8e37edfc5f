import pytest

from tests.llm.cases import WORDS, messy_rows


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with every awkward case, and extra columns whose names clash with those of the operators."""
    from tidemark.storage import ship_package

    ship_package(spark)
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, spans string, fp string, word string, digest int"
    rows = [(*r, "x", "y", "z", "w", 1) for r in messy_rows(WORDS)]
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("doc_id < -1000")
