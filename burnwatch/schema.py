"""The service-log record: one fixed schema shared by both log tables.

A record describes one service over one period.  ``EB`` records carry the error-budget view of the service
and ``RESPONSE`` records the response-time view; both have the same 83 columns.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import types as T

EB = "EB"
RESPONSE = "RESPONSE"

HEALTHY = "HEALTHY"
AT_RISK = "AT_RISK"
UNHEALTHY = "UNHEALTHY"

RED = "#FD346E"
GREEN = "#07AE86"


class Field(NamedTuple):
    """One column: its type, the JSON key it is read from, how it is cast, and the value of an absent key."""

    column: str
    dtype: str
    key: str | None
    cast: str
    default: Any


# Column, column type, JSON key, cast, default for an absent key (interface of the record feed).
# Cast "special" marks columns whose rule is written out in sources/records.py.
FIELDS: tuple[Field, ...] = tuple(
    Field(*row)
    for row in (
        ("id", "string", "key", "special", None),
        ("app_id", "int", None, "special", None),
        ("sid", "int", "transactionId", "special", None),
        ("service_name", "string", "transactionName", "special", "Unknown"),
        ("record_time", "timestamp_ntz", None, "special", None),
        ("total_count", "int", "totalCount", "int", 0),
        ("success_count", "int", "successCount", "int", 0),
        ("error_count", "int", "errorCount", "int", 0),
        ("success_rate", "double", "successRate", "float", 0.0),
        ("error_rate", "double", "errorRate", "float", 0.0),
        ("total_data_points", "double", "totalDataPoints", "float", 0.0),
        ("response_time_avg", "double", "avgResponseTime", "float", 0.0),
        ("response_time_min", "double", "avgPercentiles.25.0", "float", 0.0),
        ("response_time_max", "double", "sumResponseTime", "special", 0.0),
        ("response_time_p25", "double", "avgPercentiles.25.0", "float", 0.0),
        ("response_time_p50", "double", "avgPercentiles.50.0", "float", 0.0),
        ("response_time_p75", "double", "avgPercentiles.75.0", "float", 0.0),
        ("response_time_p80", "double", "avgPercentiles.80.0", "float", 0.0),
        ("response_time_p85", "double", "avgPercentiles.85.0", "float", 0.0),
        ("response_time_p90", "double", "avgPercentiles.90.0", "float", 0.0),
        ("response_time_p95", "double", "avgPercentiles.95.0", "float", 0.0),
        ("response_time_p99", "double", "avgPercentiles.99.0", "float", 0.0),
        ("target_error_slo_perc", "double", "shortTargetSLO", "float", 98.0),
        ("target_response_slo_sec", "double", "responseSlo", "float", 1.0),
        ("response_target_percent", "double", "responseTargetPercent", "float", 98.0),
        ("eb_allocated_percent", "double", "eBAllocatedPercent", "float", 0.0),
        ("eb_allocated_count", "int", "eBAllocatedCount", "int", 0),
        ("eb_consumed_percent", "double", "eBConsumedPercent", "float", 0.0),
        ("eb_consumed_count", "int", "eBConsumedCount", "int", 0),
        ("eb_actual_consumed_percent", "double", "eBActualConsumedPercent", "float", 0.0),
        ("eb_left_percent", "double", "eBLeftPercent", "float", 0.0),
        ("eb_left_count", "int", "eBLeftCount", "int", 0),
        ("response_allocated_percent", "double", "responseAllocatedPercent", "float", 0.0),
        ("response_allocated_count", "int", "responseAllocatedCount", "int", 0),
        ("response_consumed_percent", "double", "responseConsumedPercent", "float", 0.0),
        ("response_consumed_count", "int", "responseConsumedCount", "int", 0),
        ("response_actual_consumed_percent", "double", "responseActualConsumedPercent", "float", 0.0),
        ("response_left_percent", "double", "responseLeftPercent", "float", 0.0),
        ("response_left_count", "int", "responseLeftCount", "int", 0),
        ("response_breached", "boolean", "responseBreached", "bool", False),
        ("response_breach_count", "int", "responseBreachCount", "int", 0),
        ("response_error_rate", "double", "responseErrorRate", "float", 0.0),
        ("response_success_rate", "double", "responseSuccessRate", "float", 100.0),
        ("aspirational_slo", "double", "aspirationalSLO", "float", 99.0),
        ("aspirational_eb_allocated_percent", "double", "aspirationalEBAllocatedPercent", "float", 0.0),
        ("aspirational_eb_allocated_count", "int", "aspirationalEBAllocatedCount", "int", 0),
        ("aspirational_eb_consumed_percent", "double", "aspirationalEBConsumedPercent", "float", 0.0),
        ("aspirational_eb_consumed_count", "int", "aspirationalEBConsumedCount", "int", 0),
        ("aspirational_eb_actual_consumed_percent", "double", "aspirationalEBActualConsumedPercent", "float", 0.0),
        ("aspirational_eb_left_percent", "double", "aspirationalEBLeftPercent", "float", 0.0),
        ("aspirational_eb_left_count", "int", "aspirationalEBLeftCount", "int", 0),
        ("aspirational_response_target_percent", "double", "aspirationalResponseTargetPercent", "float", 99.0),
        ("aspirational_response_allocated_percent", "double", "aspirationalResponseAllocatedPercent", "float", 0.0),
        ("aspirational_response_allocated_count", "int", "aspirationalResponseAllocatedCount", "int", 0),
        ("aspirational_response_consumed_percent", "double", "aspirationalResponseConsumedPercent", "float", 0.0),
        ("aspirational_response_consumed_count", "int", "aspirationalResponseConsumedCount", "int_or_zero", 0),
        ("aspirational_response_actual_consumed_percent", "double", "aspirationalResponseActualConsumedPercent", "float", 0.0),
        ("aspirational_response_left_percent", "double", "aspirationalResponseLeftPercent", "float", 0.0),
        ("aspirational_response_left_count", "int", "aspirationalResponseLeftCount", "int", 0),
        ("timeliness_consumed_percent", "double", "timelinessConsumedPercent", "float", 0.0),
        ("aspirational_timeliness_consumed_percent", "double", "aspirationalTimelinessConsumedPercent", "float", 0.0),
        ("timeliness_health", "string", "timelinessHealth", "str", HEALTHY),
        ("eb_health", "string", "ebHealth", "str", HEALTHY),
        ("response_health", "string", "responseHealth", "str", HEALTHY),
        ("aspirational_eb_health", "string", "aspirationalEBHealth", "str", HEALTHY),
        ("aspirational_response_health", "string", "aspirationalResponseHealth", "str", HEALTHY),
        ("timeliness_severity", "string", "timelinessSeverity", "str", GREEN),
        ("eb_or_response_breached", "boolean", "ebOrResponseBreached", "bool", False),
        ("response_severity", "string", "responseSeverity", "str", GREEN),
        ("eb_severity", "string", "ebSeverity", "str", GREEN),
        ("aspirational_response_severity", "string", "aspirationalResponseSeverity", "str", GREEN),
        ("aspirational_eb_severity", "string", "aspirationalEBSeverity", "str", GREEN),
        ("burn_rate", "double", "burnRate", "float", 0.0),
        ("eb_breached", "boolean", "ebBreached", "bool", False),
        ("eb_slo_status", "string", "eBSloStatus", "str", "APPROVED"),
        ("sort_data", "double", "sortData", "float", 0.0),
        ("data_for", "string", "dataFor", "str", "TRANSACTION"),
        ("timezone", "string", "timezone", "str", "UTC"),
        ("sre_product", "string", "sre_product", "str", ""),
        ("project_id", "int", "projectId", "int_or_zero", 0),
        ("project_name", "string", "projectName", "str", ""),
        ("application_name", "string", "applicationName", "str", ""),
        ("data_category", "string", "dataCategory", "str", EB),
    )
)

COLUMNS: tuple[str, ...] = tuple(f.column for f in FIELDS)

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}
SERVICE_LOG_SCHEMA = T.StructType([T.StructField(f.column, _TYPES[f.dtype]) for f in FIELDS])

# Percentile columns and the fraction each one holds.
RESPONSE_QUANTILES: dict[str, float] = {f"response_time_p{p}": p / 100 for p in (25, 50, 75, 80, 85, 90, 95, 99)}
