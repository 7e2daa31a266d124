import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from texts, with ids from 0."""

    def make(texts, sources=None, langs=None):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make

