"""Fixtures of the training-data tests; imported by name, as a second conftest would hide the first."""

import pytest


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties and extra columns with clashing names."""

    def build(texts, first=0):
        rows = [(first + at, text, "x", 1, True, 0.5) for at, text in enumerate(texts)]
        rows += [rows[-1], (None, "a row without an id\nand a second line", "x", 1, None, None)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, hash string, score int, keep boolean, ids double"
        )

    return build


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
