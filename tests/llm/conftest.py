import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = [(r + (None,) * 4)[:4] + (None if r[1] is None else len(r[1]),) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture
def by_id():
    def collect(df, key="doc_id"):
        return {r[key]: r.asDict() for r in df.collect()}

    return collect

