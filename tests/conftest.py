"""A local session and the comparison with DuckDB that the tests share."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tidewater.session import session

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def oracle():
    base = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base
