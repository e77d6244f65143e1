"""Documents with everything that real tables hold."""

from __future__ import annotations

import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, block string"
SF_DIR = "/root/testdata/sf0.001"


def sentence(draw: random.Random, words: int) -> str:
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, extra columns."""
    draw = random.Random(3)
    base = sentence(draw, 60)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, base), (6, base), (7, base.upper()), (7, base.upper()),
        (8, base + " one more"), (9, sentence(draw, 12) + "\n" + base), (10, sentence(draw, 30_000)), (None, base), (12, "ß é 日本 \U0001f600"),
        (13, "\n".join([sentence(draw, 6)] * 4)), (14, "x" * 200_000),
    ]
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 2 else "s", None, 0.5, "b") for i, t in rows], SHAPE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given tables."""
    import os

    if not os.path.isdir(SF_DIR):
        pytest.skip("needs the given tables")
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
