import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_fixtures import prose  # noqa: E402

@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = prose(99, 30_000)
    rows = [(1, prose(1, 60), "en", "a", 1, True, "x"), (2, prose(1, 60), "en", "a", 1, False, "y"),
            (3, prose(1, 60) + " more", None, None, None, None, None), (4, "", "en", "b", 0, None, None),
            (5, None, None, None, None, True, None), (6, " \n ", "de", "b/c", 3, None, None),
            (7, "one two", "de", "b/c", 7, None, None), (7, "one two", "de", "b/c", 7, None, None),
            (8, long, "en", "a", 2, None, None), (9, long + " tail", "en", "a", 2, None, None),
            (None, prose(3, 50), "en", "a", 1, None, None), (None, None, None, None, None, None, None),
            (10, "日本語 テキスト 🙂 été " * 20, "fr", "ü/é", 5, None, None), (11, "a" * 500, "en", "a", 5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept boolean, sequence_id string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (8, 1, 0), (8, 0, 1), (10, 0, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
