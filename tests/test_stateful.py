"""State on streams: alerts, and each id once."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest

from burnwatch.sources.pages import page_items
from burnwatch.sources.records import accepted, sourced_records, typed_items
from burnwatch.streaming.alerts import CHANGES, alert_changes, burn_alerts
from burnwatch.streaming.ingest import first_records, page_stream

START = datetime(2024, 1, 1)
RATES = {
    "up": [0.1, 2.5, 1.5, 1.2, 0.9, 0.2, 3.0],
    "edge": [2.0, 1.0, 1.0, 0.999, 1.999],
    "gaps": [None, 5.0, None, None, 0.5, None],
    "calm": [0.0, 0.5, 1.9],
}


def windows(spark, rates=RATES):
    def severity(r):
        return "healthy" if r is None or r < 1 else "warning" if r < 2 else "critical"

    rows = [
        (s, START + timedelta(hours=i), START + timedelta(hours=i + 1), r, severity(r)) for s, found in rates.items() for i, r in enumerate(found)
    ]
    return spark.createDataFrame(rows, "service_name string, window_start timestamp_ntz, window_end timestamp_ntz, burn_rate double, severity string")


def at(hour):
    return START + timedelta(hours=hour)


def test_alerts_are_raised_held_and_cleared(spark):
    found = sorted(map(tuple, burn_alerts(windows(spark).repartition(3)).collect()), key=repr)
    assert found == sorted(
        [
            ("up", at(1), at(4), 3, 2.5, at(1), "critical"),
            ("up", at(6), None, 1, 3.0, at(6), "critical"),
            ("edge", at(0), at(3), 3, 2.0, at(0), "critical"),
            ("gaps", at(1), at(4), 3, 5.0, at(1), "critical"),
        ],
        key=repr,
    )


def test_one_threshold_is_a_plain_run_of_windows(spark):
    found = burn_alerts(windows(spark, {"a": [1.0, 0.9, 1.0, 1.1]}), 1.0, 1.0).orderBy("raised_at").collect()
    assert [(r.raised_at, r.cleared_at, r.windows) for r in found] == [(at(0), at(1), 1), (at(2), None, 2)]
    with pytest.raises(ValueError, match="cannot be cleared"):
        burn_alerts(windows(spark), 1.0, 2.0)


def test_no_windows_no_alerts(spark):
    assert burn_alerts(windows(spark).limit(0)).count() == 0
    assert alert_changes(windows(spark).limit(0)).count() == 0


def run_to_end(frame, name, tmp_path):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return frame.sparkSession.table(name)


def test_a_stream_of_windows_has_the_changes_of_a_batch(spark, tmp_path):
    """Windows come two hours a batch; state is carried over batches and a late window is passed over."""
    folder = tmp_path / "windows"
    frame = windows(spark)
    schema = frame.schema
    for batch in range(4):
        part = frame.filter(f"window_start >= timestamp_ntz'{at(2 * batch)}' AND window_start < timestamp_ntz'{at(2 * batch + 2)}'")
        part.coalesce(1).write.parquet(f"{folder}/b{batch}")
    late = frame.filter(f"service_name = 'calm' AND window_start = timestamp_ntz'{at(0)}'").selectExpr("* EXCEPT (burn_rate)", "9D AS burn_rate")
    late.select(*schema.names).coalesce(1).write.parquet(f"{folder}/b9")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    found = run_to_end(alert_changes(stream), "changes", tmp_path)
    assert found.schema == spark.createDataFrame([], CHANGES).schema
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, alert_changes(frame).collect()))
    assert found.count() == 7


def test_a_stream_hands_on_each_id_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(n, *items):
        path = landing / f"page_{n}.json"
        path.write_text(json.dumps(list(items)))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times

    def item(key, hour, **extra):
        return {"key": key, "totalCount": n_of(key), "at": f"2024-01-01 {hour:02d}:00:00"} | extra

    def n_of(key):
        return ord(key[0])

    land(0, item("a", 1), item("b", 1), item("a", 1), item("x", 1, totalCount=None), {"totalCount": 1, "at": "2024-01-01 01:00:00"})
    land(1, item("a", 2), item("c", 2, dataCategory="RESPONSE"), item("c", 2), item("d", 2, at="soon"))
    land(2, item("e", 20))
    land(3, item("f", 20), item("e", 20))
    land(4, item("late", 1))
    stream = page_stream(spark, str(landing), files_per_batch=1)
    found = run_to_end(first_records(stream, "at", watermark="6 hours"), "once", tmp_path)
    rows = sorted((r.data_category, r.id.rsplit("/")[-1], r.record_time) for r in found.collect())
    hour = lambda h: START + timedelta(hours=h)
    # "late" is later than the watermark.
    assert rows == sorted(
        [
            ("EB", "a", hour(1)), ("EB", "b", hour(1)), ("EB", "f", hour(20)), ("EB", "c", hour(2)), ("EB", "e", hour(20)),
            ("RESPONSE", "c", hour(2)), ("EB", "page_*.json:0:4", hour(1)),
        ]
    )
    batch = sourced_records(accepted(typed_items(page_items(spark.read.text(str(landing), wholetext=True).selectExpr(
        "CAST(regexp_extract(_metadata.file_name, '(\\\\d+)', 1) AS BIGINT) AS page_id", "value AS body")), event_time_key="at")).filter("has_id"))
    firsts = {(r.data_category, r.id) for r in batch.filter("record_time IS NOT NULL AND id <> 'late'").collect()}
    assert {r[:2] for r in rows if ":" not in r[1]} == firsts
