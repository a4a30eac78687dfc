"""Recent window against the one before it, and volume over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate, named, number
from burnwatch.functions.scoring import change_severity, exceeds, or_zero, or_zero_count, percent_change
from burnwatch.plans.quantiles import join_on_keys
from burnwatch.plans.tables import SloTables, TimeLike, as_time, for_service, in_time_range, minutes

WINDOW_MINUTES = 30
THRESHOLD_PERCENT = 20.0

_METRICS = {
    "error_rate": "error_rate",
    "response_time": "response_time_avg",
    "response_time_p95": "response_time_p95",
    "response_time_p99": "response_time_p99",
}
_CHANGES = [f"{metric}_change_percent" for metric in _METRICS]


def _anchor(tables: SloTables, as_of: TimeLike) -> Column:
    return tables.latest_time() if as_of is None else as_time(as_of)


def _change(metric: str) -> str:
    change = percent_change(f"{metric}_baseline", f"{metric}_recent")
    return or_zero(change) if metric in ("response_time_p95", "response_time_p99") else change


def degrading_services(
    tables: SloTables,
    time_window_minutes: float = WINDOW_MINUTES,
    threshold_percent: float = THRESHOLD_PERCENT,
    *,
    as_of: TimeLike = None,
) -> DataFrame:
    """Services whose error rate or latency rose by more than the threshold from one window to the next.

    The recent window is closed at both ends and ends at ``as_of`` (the newest record by default); the baseline is as long,
    ends where the recent one starts, and leaves that instant out.  Both are conditional aggregates of one scan.
    """
    end = _anchor(tables, as_of)
    start = end - minutes(time_window_minutes)
    rows = in_time_range(tables.eb, end - minutes(2 * time_window_minutes), end).withColumn(
        "_recent", F.col("record_time") >= start
    )
    windows = {"recent": "_recent", "baseline": "NOT _recent"}
    averages = {
        f"{metric}_{window}": f"avg(CASE WHEN {inside} THEN {column} END)"
        for metric, column in _METRICS.items()
        for window, inside in windows.items()
    }
    volumes = {
        "_recent_rows": "count_if(_recent)",
        "_baseline_rows": "count_if(NOT _recent)",
        "_requests": "sum(CASE WHEN _recent THEN total_count END)",
        "_errors": "sum(CASE WHEN _recent THEN error_count END)",
    }
    compared = (
        aggregate(rows, ["service_name"], volumes | averages)
        .filter("_recent_rows > 0 AND _baseline_rows > 0")
        .selectExpr("*", *named({f"{metric}_change_percent": _change(metric) for metric in _METRICS}))
    )
    largest = F.expr(f"CASE WHEN {_CHANGES[0]} IS NOT NULL THEN greatest({', '.join(_CHANGES)}) END")
    return (
        compared.filter(" OR ".join(exceeds(change, number(float(threshold_percent))) for change in _CHANGES))
        .orderBy(largest.desc_nulls_last(), F.col("service_name").asc_nulls_last())
        .selectExpr(
            "service_name",
            *[f"{m}_{part}" for m in _METRICS for part in ("recent", "baseline", "change_percent")],
            f"{or_zero_count('_requests')} AS total_requests_recent",
            f"{or_zero_count('_errors')} AS total_errors_recent",
            f"{change_severity(*_CHANGES)} AS severity",
        )
    )


def _trend_rows(tables: SloTables, service_name: str | None, window: float, as_of: TimeLike) -> DataFrame:
    end = _anchor(tables, as_of)
    return in_time_range(for_service(tables.eb, service_name), end - minutes(window), end)


_SUMMARY = {
    "total_volume": or_zero_count("sum(total_count)"),
    "total_errors": or_zero_count("sum(error_count)"),
    "avg_error_rate": or_zero("avg(error_rate)"),
    "avg_response_time": or_zero("avg(response_time_avg)"),
}


def volume_summary(
    tables: SloTables,
    service_name: str | None = None,
    time_window_minutes: float = WINDOW_MINUTES,
    *,
    as_of: TimeLike = None,
) -> DataFrame:
    """Total volume and mean rates per service over the window."""
    return aggregate(_trend_rows(tables, service_name, time_window_minutes, as_of), ["service_name"], _SUMMARY)


def volume_trends(
    tables: SloTables,
    service_name: str | None = None,
    time_window_minutes: float = WINDOW_MINUTES,
    *,
    as_of: TimeLike = None,
) -> DataFrame:
    """The time series of each service over the window, one row per record, with the service's summary beside it.

    The series stays in rows instead of an array, so its length per service is not limited by a task.
    """
    rows = _trend_rows(tables, service_name, time_window_minutes, as_of)
    points = rows.selectExpr(
        "service_name",
        f"{number(time_window_minutes)} AS time_window_minutes",
        "record_time AS timestamp",
        "id AS _id",
        f"{or_zero_count('total_count')} AS total_requests",
        f"{or_zero_count('error_count')} AS errors",
        f"{or_zero('error_rate')} AS error_rate",
        f"{or_zero('response_time_avg')} AS response_time",
    )
    summary = aggregate(rows, ["service_name"], _SUMMARY).selectExpr(
        "service_name", f"struct({', '.join(_SUMMARY)}) AS summary"
    )
    return (
        join_on_keys(points, summary, ["service_name"])
        .orderBy(F.col("service_name").asc_nulls_last(), "timestamp", "_id")
        .drop("_id")
    )
