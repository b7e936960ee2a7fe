from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHES = ["row", "k", "v", "doc", "version", "t", "fp", "spans", "bad", "line", "first", "root", "range", "lang_pred", "score", "ids"]
PROSE = " ".join(f"word{i % 97} of{i % 31} text{i % 53}" for i in range(60))


def plain(rows: list[tuple], spark):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, PROSE, None, None, None), (None, PROSE, "en", "b", 1), (None, None, None, None, None),
        (3, None, "de", "c", 0), (4, "", "de", "c", 0), (5, " \n\t\n ", "fr", "d", 4), (6, "one two", "fr", "d", 7), (7, "日本語 😀 Ω \x00 é x", None, "e", 5),
        (8, ("long text number %s and more\n" * 20_000) % tuple(range(20_000)), "en", "a", 1), (9, "x" * 200_000, "es", "b", 1), (3, "other text", "de", "c", 0),
    ]
    out = plain(rows, spark)
    return out.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, None), (7, None, 0), (None, 1, 0), (8, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[20:40])), (2, "one two"), (2, None), (3, ""), (None, "one two"), (4, "Text-Number long")], "item_id bigint, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
