import datetime as dt
import os
import sys

import pytest
from llm_cases import EDGE, SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns of clashing names."""
    rows = [(i, t, la, s, n, "x", 1, True, [1], dt.date(2024, 1, 1)) for i, t, la, s, n in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, count string, key int, "
              "score boolean, ids array<int>, copy date").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
