import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


CLASHES = ("id", "row", "words", "hashes", "key", "group", "bucket", "rep", "size", "n", "start",
           "first", "count", "digest", "runs", "place", "length", "low", "high", "block")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, blanks, ties, repeated rows, one very long text, and columns with clashing names."""
    words = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, words), (4, words), (5, words), (6, passage),
            (7, passage + " tail"), (None, passage), (8, "one two"), (9, "one two"), (10, "é" * 300),
            (11, "<|endoftext|> it's 日本 × ÷ \x1c")]
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([r + (None,) * (3 + len(CLASHES)) for r in rows],
                                 f"doc_id long, text string, lang string, source string, "
                                 f"n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false").coalesce(1)
