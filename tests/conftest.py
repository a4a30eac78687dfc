from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from burnwatch import SloTables  # noqa: E402
from burnwatch.schema import FIELDS, SERVICE_LOG_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logs(spark):
    """Builds a log table from rows that name only the columns they care about."""

    def build(*rows: dict):
        filled = []
        for i, row in enumerate(rows):
            base = {f.column: f.default for f in FIELDS}
            base |= {"id": f"r{i:03d}", "service_name": "a", "record_time": datetime(2024, 1, 1)}
            filled.append(tuple((base | row)[f.column] for f in FIELDS))
        return spark.createDataFrame(filled, SERVICE_LOG_SCHEMA)

    return build


@pytest.fixture(scope="session")
def tables(logs):
    def build(eb: list[dict], resp: list[dict] = ()):
        return SloTables.from_pair(logs(*eb), logs(*resp))

    return build
