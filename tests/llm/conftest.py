from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """(doc_id, text) pairs -> documents, with a column that clashes with inner names."""

    def make(rows, columns=COLUMNS + ", id string, code string, hits string"):
        full = [(i, t, "en", f"src{(i or 0) % 2}", len(t or ""), "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(full, columns).repartition(3)

    return make
