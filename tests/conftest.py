"""One local session and the small book of the tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from book_helpers import make_claims, make_policies
from ratespark.operators.datasets import clean_frequency_data
from ratespark.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_policies(spark):
    return make_policies(spark).cache()


@pytest.fixture(scope="session")
def raw_claims(raw_policies):
    return make_claims(raw_policies).cache()


@pytest.fixture(scope="session")
def policies(raw_policies):
    return clean_frequency_data(raw_policies).cache()
