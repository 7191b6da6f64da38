"""Odd and ordinary documents that every text operator has to take."""

import pytest

LONG = " ".join(f"w{i % 977} and the {i}" for i in range(9000))
GOOD = "The quick brown fox jumps over the lazy dog and runs far away into the deep green woods. "
EXTRA = ("score double, shard int, slot long, fp long, rank long, cell int, text_hash long, copy long, "
         "block string, key string, words binary, kind int, piece int, size long, u long, v long")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def rows_of(texts):
    """(doc_id, text) pairs with the extra columns that clash with inner names."""
    clash = (0.5, 7, 7, 7, 7, 7, 7, 7, "b", "k", b"w", 7, 7, 7, 7, 7)
    return [(i, t, "en", "src0", len(t or ""), *clash) for i, t in texts]


ODD = [
    (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a"), (4, "One  two\n\nthree "), (5, LONG),
    (6, "x" * 30_000), (7, GOOD * 3), (8, GOOD * 3), (8, GOOD * 3), (9, GOOD * 3 + "end"),
    (10, "Äé ß 漢字   　 \U0001f600 naïve line"), (11, "a<|endoftext|> b <|endoftext|>"),
    (12, "line one\nline one\nline two\nline one"), (13, "!!! ### $$$ %%% | | | <> <>"),
    (None, "no id here at all"), (None, None), (14, "\x00 \x1c control \x85 x"), (15, "aB Cd EF"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(3, 0, 0), (7, 1, 0), (8, 1, 0), (13, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
