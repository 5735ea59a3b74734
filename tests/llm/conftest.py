from __future__ import annotations

import pytest

LONG = " ".join(f"wort{i % 977} lange{i % 13}" for i in range(20_000))

#: Nulls, empty and blank texts, equal rows, equal ids, a very long text, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "de", None),
    (5, " \t\n\x0b ", "de", None),
    (6, "eins", None, "b"),
    (7, LONG, "de", "b"),
    (8, "12 34 !! ?? 56", "en", "c"),
    (8, "12 34 !! ?? 56", "en", "c"),
    (9, "zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "c"),
    (9, "deux trois quatre cinq six sept huit neuf dix onze", "fr", "c"),
    (None, "zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "c"),
    (None, None, None, None),
    (10, "naïve     日本語 😀 <|endoftext|> a\u0000b \U000e0fff x", "fr", "d"),
]
#: Names that operators use for columns of their own.
CLASHES = ("score", "predicted", "n_tokens", "language", "place", "shard", "slot", "mix", "size", "class_id", "node", "toxic_score", "text_hash", "bucket", "__mix_size", "__mix_place", "__more", "__text_hash", "__again", "__ident", "row", "salt", "key", "_id", "_toxic", "plan", "start")


@pytest.fixture(scope="session")
def edge(spark):
    """The odd rows, with extra columns under clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for i, c in enumerate(CLASHES):
        df = df.selectExpr("*", f"'x{i}' AS {c}")
    return df


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (7, 1, 0), (9, 1, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
