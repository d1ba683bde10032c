from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h int, fp string, tk int, w array<string>, ids string, `p.q` int"


def make_docs(spark, rows):
    """(doc_id, text[, lang]) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", 1, "y", 2, ["z"], "i", 3) for r in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
#: Nulls, empty and white texts, a long text, repeated rows, copies, odd characters.
EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "no id at all"), (5, LONG), (6, LONG), (7, "ünïcødé 日本語 👨‍👩‍👧 \x00 a\x85b"), (8, "!!! ??? 123"), (9, "a  b\n\nc "), (None, None), (10, "the quick brown fox jumps over the lazy dog " * 20), (11, "the quick brown fox jumps over the lazy dog " * 20)]


@pytest.fixture(scope="session")
def edges(spark):
    return make_docs(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [])
