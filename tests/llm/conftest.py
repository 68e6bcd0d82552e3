import pytest


@pytest.fixture()
def docs(spark):
    """Makes documents of (doc_id, text) with further columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, node string, label int")

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "wörd ▁ \x00 日本語 </s> " * 50), (7, "z" * 70_000), (8, "a b " * 20_000)]


@pytest.fixture()
def edge_rows():
    """Null, empty, blank, short, repeated, odd and very long texts."""
    return EDGES
