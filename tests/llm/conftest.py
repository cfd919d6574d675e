import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from prose import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``documents`` from (doc_id, text) or longer rows; the other columns are null if left out."""

    def make(rows, schema=SCHEMA):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that operators use themselves."""
    long = "\n".join(prose(i, 60) for i in range(400))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\r ", "en", "a"), (4, long, "en", "a"), (5, "one", "de", "b"), (5, "one", "de", "b"),
            (None, prose(7), "en", None), (6, "éß 中文 \U0001f600", None, "b"), (7, prose(7), "en", "b")]
    names = "node long, key long, size long, kept boolean, score double, label int, base_spans string, copies long, target string, root long, held_out boolean"
    return docs([(r[0], r[1], r[2], r[3], None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + names)
