"""Streaming forms against their batch counterparts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from burnwatch import SloTables
from burnwatch.contract.fixture import EVENT_RULES
from burnwatch.operators.sli import current_sli
from burnwatch.schema import RESPONSE_QUANTILES, SERVICE_LOG_SCHEMA
from burnwatch.sources.rollup import daily_tables
from burnwatch.sources.store import SnapshotStore
from burnwatch.streaming.burn import sliding_burn_rate
from burnwatch.streaming.ingest import continuous_ingest, page_stream
from burnwatch.streaming.rollup import daily_indicators

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def event_stream(spark, tmp_path_factory):
    """The events as three files, in time order, and one event that is far too late in a fourth."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(EVENTS)
    third = F.ntile(3).over(Window.orderBy("ts"))
    parts = events.withColumn("part", third).persist()
    for part in (1, 2, 3):
        parts.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{folder}/f{part}")
    late = events.orderBy("ts").limit(1)
    late.coalesce(1).write.parquet(f"{folder}/f4")
    parts.unpersist()

    def stream():
        return (
            spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        )

    return stream


def run_to_end(frame, name, tmp_path, mode="append"):
    query = (
        frame.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return frame.sparkSession.table(name)


def test_daily_indicators(spark, event_stream, tmp_path):
    found = run_to_end(daily_indicators(event_stream(), EVENT_RULES), "daily", tmp_path)
    rows = {r.id: r for r in found.collect()}
    batch = {r.id: r for r in daily_tables(spark.read.parquet(EVENTS), EVENT_RULES).logs.collect()}
    # The last day stays open until the watermark passes it.
    last_day = max(r.record_time for r in batch.values())
    assert {k for k, r in batch.items() if r.record_time < last_day} <= set(rows) <= set(batch)
    exact = [c for c in SERVICE_LOG_SCHEMA.names if c not in RESPONSE_QUANTILES]
    for key, row in rows.items():
        for column in exact:
            value = batch[key][column]
            assert row[column] == (pytest.approx(value) if isinstance(value, float) else value), column
        # An element of the group near the interpolated rank.
        assert row.response_time_p25 <= row.response_time_p50 <= row.response_time_p99 <= row.response_time_max
    # Operators run on the rows of the stream.
    assert current_sli(SloTables.from_logs(found)).count() == len({r.service_name for r in rows.values()})


def test_sliding_burn_rate(spark, event_stream, tmp_path):
    sizes = {"window": "12 hours", "slide": "6 hours"}
    found = run_to_end(sliding_burn_rate(event_stream(), EVENT_RULES, watermark="1 hour", **sizes), "burn", tmp_path)
    batch = sliding_burn_rate(spark.read.parquet(EVENTS), EVENT_RULES, **sizes)
    rows, expected = ({(r.service_name, r.window_start): r for r in f.collect()} for f in (found, batch))
    assert len(rows) > 0.9 * len(expected)
    for key, row in rows.items():
        assert row == expected[key]


def test_continuous_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def land(n, *items):
        (landing / f"page_{n}.json").write_text(json.dumps({"summary": list(items)}))

    def refresh():
        pages = page_stream(spark, str(landing))
        query = continuous_ingest(store, pages, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    land(0, {"key": "a", "totalCount": 1}, {"key": "x", "totalCount": None})
    refresh()
    assert [r.id for r in store.tables().eb.collect()] == ["a"]
    land(1, {"key": "b", "totalCount": 1}, {"key": "r", "dataCategory": "RESPONSE"})
    refresh()
    tables = store.tables(history=True)
    assert sorted(r.id for r in tables.eb.collect()) == ["a", "b"]
    assert [r.id for r in tables.resp.collect()] == ["r"]
    assert [r.bad_keys for r in store.rejected(0).collect()] == [["totalCount"]]


def test_uneven_windows(spark):
    """Half-hour windows every twenty minutes over one event a minute, none lost and none counted twice."""
    events = spark.range(60).selectExpr(
        "timestampadd(MINUTE, id, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts", "1 AS user_id", "'view' AS event_type"
    )
    found = sliding_burn_rate(events, EVENT_RULES, window="30 minutes", slide="20 minutes").orderBy("window_start")
    assert [r.total_requests for r in found.collect()] == [10, 30, 30, 20]
