import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
EDGE_TEXTS = [
    (1, "alpha beta gamma delta. " * 30, "a"),
    (2, PASSAGE + " then its own ending one", "a"),
    (3, "another opening here " + PASSAGE, "b"),
    (4, "alpha beta gamma delta. " * 30, None),
    (4, "alpha beta gamma delta. " * 30, None),  # a repeated row
    (5, None, "b"),
    (6, "", "c"),
    (7, " \t\n ", "c"),
    (8, LONG, "b"),
    (9, LONG + " tail", "b"),
    (None, "an id that is missing " + PASSAGE, "a"),
    (None, "an id that is missing " + PASSAGE, "a"),
    (10, "näïve ünïcode ßtraße 😀 日本語 " * 9 + "\n\nline\nline\n", ""),
    (4, "the same id with another text", "a"),
]
CLASH = ("ids", "kept", "fp", "k", "n", "rank", "cell", "size", "target", "rest", "slot", "root", "u", "v", "quality",
         "id", "late", "th")


@pytest.fixture(scope="session")
def spark():
    from vigil.session import local_session

    yield local_session("4", shuffle_partitions=4, app="vigil-llm-tests")


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, s in EDGE_TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
