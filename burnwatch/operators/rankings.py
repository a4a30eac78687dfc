"""Top-k reports over one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate
from burnwatch.functions.health import worst_health
from burnwatch.functions.scoring import or_zero, or_zero_count
from burnwatch.plans.tables import SloTables

TOP = 10


def _ranked(df: DataFrame, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.expr(key).desc_nulls_last(), F.col("service_name").asc_nulls_last()).limit(limit)


def _met(value: str, target: str) -> str:
    """Whether the value is within its target; true when either is missing."""
    return f"coalesce({value} <= {target}, true)"


def top_services_by_volume(tables: SloTables, limit: int = TOP) -> DataFrame:
    totals = aggregate(
        tables.eb,
        ["service_name"],
        {
            "total_requests": "sum(total_count)",
            "avg_error_rate": "avg(error_rate)",
            "avg_response_time": "avg(response_time_avg)",
        },
    )
    return _ranked(totals, "total_requests", limit).selectExpr(
        "service_name",
        f"{or_zero_count('total_requests')} AS total_requests",
        f"{or_zero('avg_error_rate')} AS avg_error_rate",
        f"{or_zero('avg_response_time')} AS avg_response_time",
    )


def slowest_services(tables: SloTables, limit: int = TOP) -> DataFrame:
    """Slowest services by average p99 latency, or by average latency where no p99 is known."""
    totals = aggregate(
        tables.resp,
        ["service_name"],
        {
            "avg_response_time": "avg(response_time_avg)",
            "p50": "avg(response_time_p50)",
            "p95": "avg(response_time_p95)",
            "p99": "avg(response_time_p99)",
            "max_response_time": "max(response_time_max)",
            "response_slo_target": "max(target_response_slo_sec)",
            "total_requests": "sum(total_count)",
        },
    )
    latency = "coalesce(p99, avg_response_time)"
    return _ranked(totals, latency, limit).selectExpr(
        "service_name",
        f"{or_zero('avg_response_time')} AS avg_response_time",
        "p50 AS response_time_p50",
        "p95 AS response_time_p95",
        "p99 AS response_time_p99",
        f"{or_zero('max_response_time')} AS max_response_time",
        "coalesce(response_slo_target, 1D) AS response_slo_target",
        f"{or_zero_count('total_requests')} AS total_requests",
        f"{_met(latency, 'response_slo_target')} AS slo_met",
    )


def error_prone_services(tables: SloTables, limit: int = TOP) -> DataFrame:
    totals = aggregate(
        tables.eb,
        ["service_name"],
        {
            "avg_error_rate": "avg(error_rate)",
            "total_errors": "sum(error_count)",
            "total_requests": "sum(total_count)",
            "error_slo_target": "max(target_error_slo_perc)",
        },
    )
    return _ranked(totals.filter("avg_error_rate > 0"), "avg_error_rate", limit).selectExpr(
        "service_name",
        "avg_error_rate",
        f"{or_zero_count('total_errors')} AS total_errors",
        f"{or_zero_count('total_requests')} AS total_requests",
        f"{or_zero('error_slo_target')} AS error_slo_target",
        f"{_met('avg_error_rate', 'error_slo_target')} AS slo_met",
    )


def services_by_burn_rate(tables: SloTables, limit: int = TOP) -> DataFrame:
    totals = aggregate(
        tables.eb,
        ["service_name"],
        {
            "avg_burn_rate": "avg(burn_rate)",
            "avg_eb_consumed": "avg(eb_actual_consumed_percent)",
            "avg_eb_left": "avg(eb_left_percent)",
            "avg_error_rate": "avg(error_rate)",
            "eb_health": worst_health("eb_health"),
        },
    )
    return _ranked(totals.filter("avg_burn_rate > 0"), "avg_burn_rate", limit).selectExpr(
        "service_name",
        "avg_burn_rate",
        f"{or_zero('avg_eb_consumed')} AS avg_eb_consumed",
        f"{or_zero('avg_eb_left')} AS avg_eb_left",
        f"{or_zero('avg_error_rate')} AS avg_error_rate",
        "eb_health",
    )
