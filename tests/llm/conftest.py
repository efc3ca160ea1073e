import random

import pytest

VOCABULARY = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"] + [f"word{i}" for i in range(300)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(VOCABULARY[:10]) if r.random() < 0.4 else r.choice(VOCABULARY) for _ in range(n)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source: nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, "same text here", "en", "b"), (2, "same  text\nhere", "en", "a"), (3, "same text here", None, None), (3, "same text here", None, None), (4, None, "en", "a"), (5, "", "de", "c"), (6, " \n\t", "en", "a"),
        (None, "no id at all", "en", "a"), (7, long, "en", "b"), (8, long + " end", "en", "b"), (9, "one", "fr", "c"), (10, "é ü 中文 words", "zh", "é"), (11, prose(2, 80), "en", "b"), (12, prose(2, 80), "en", "a"), (13, "x" * 50_000, "en", "a"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edge_rows):
    """The same rows with columns named like those that operators make for themselves."""
    names = ["row", "id", "n", "node", "size", "key", "label", "text_digest", "copy_number", "mixed_id", "mixed_times", "mixed_copy", "score"]
    return spark.createDataFrame([(*r, *([k] * len(names))) for k, r in enumerate(edge_rows)], SCHEMA + "".join(f", {n} int" for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
