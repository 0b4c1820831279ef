from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plinth.staging import build_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "plinth-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.default.parallelism": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def raw_listings(spark):
    """Five raw rows; the last repeats the first."""
    from plinth.schemas import RAW_LISTING

    first = ("Super built-up  Area", "19-Dec", " Whitefield ", "2 BHK", "ABC", "1200", 2.0, 1.0, 60.0)
    return spark.createDataFrame(
        [
            first,
            ("Plot  Area", "Ready To Move", "whitefield", "3 BHK", None, "1133 - 1384", 3.0, None, 80.0),
            ("Built-up  Area", None, "Hebbal", "4 Bedroom", None, "2400", 4.0, 2.0, 150.0),
            (None, "18-May", None, "1 RK", None, "call owner", 1.0, 0.0, 25.0),
            first,
        ],
        RAW_LISTING,
    )
