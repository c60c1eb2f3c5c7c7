import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_helpers import EDGE_ROWS  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, and extra columns whose names could clash."""
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F
    for name in ("key", "n", "size", "shard", "word", "rep", "sha", "at", "score", "row", "id"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
