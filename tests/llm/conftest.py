import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from llm_helpers import docs_of  # noqa: E402

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, wordless and very long texts, ties, repeated rows."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    long = " ".join(r.choice(words) + str(r.randrange(500)) for _ in range(40_000))
    base = " ".join(r.choice(words) for _ in range(120))
    rows = [
        (1, base, "en", "s1"), (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base + " omega", "en", None), (4, None, None, None), (5, "", "en", "s2"),
        (6, " \n\t ", "fr", "s2"), (7, "??? !!! ***", "fr", "s2"), (8, long, "de", "s3"), (9, long + " end", "de", "s3"), (None, base, None, "s1"), (None, None, "en", "s1"),
        (10, "Released under the MIT License. MIT license", "en", "s4"), (11, "日本語 テキスト é", "de", "s4"), (12, "one two", "es", "s4"),
    ]
    return docs_of(spark, rows)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
