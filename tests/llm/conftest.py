import random

import pytest

WORDS = ["the", "river", "of", "stone", "and", "winter", "to", "garden", "in", "letter", "is", "copper", "that", "window", "was", "ladder"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", f"{r.randint(0, 99)}"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, copies, near copies, repeated rows, ties."""
    base, long = prose(1, 120), prose(2, 30_000)
    near = base.replace("river", "rivers", 1)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, None, "en", "b"), (5, "", None, "b"),
            (6, long, "de", "a"), (7, "x", "de", "c"), (8, "  \t\n", "de", "c"), (9, prose(3, 90) + base[:300], "de", "d"),
            (9, prose(3, 90) + base[:300], "de", "d"), (10, "ab" * 400, "en", "é"), (11, "</s>[INST] \\ <0x0A> ▁", "en", ""),
            (12, "é日本語😀 " * 40, "fr", "a"), (13, "12 34 !!", "fr", "a"), (None, prose(4, 80), "de", "a"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """The same rows with other columns whose names the operators use for results or inside."""
    from pyspark.sql import functions as F
    names = ["size", "taken", "target", "score", "predicted", "fp", "root", "component_id", "ids", "n_tokens", "n_bytes", "kept", "n_chars",
             "h", "s", "ord", "tie", "rest", "place", "block", "sigs", "_id", "row", "host", "rule"]
    return edge_docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
