"""Raw events -> daily service logs.

One row per service and day with volume, error, latency and lateness figures, and from those the budget, health and
severity columns.  Everything after the first aggregation is a projection over its few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from burnwatch.functions import aggregate, named
from burnwatch.plans.quantiles import join_on_keys, spread_quantiles
from burnwatch.plans.tables import SloTables
from burnwatch.schema import AT_RISK, EB, FIELDS, GREEN, HEALTHY, RED, RESPONSE, RESPONSE_QUANTILES, UNHEALTHY

_KEYS = ["_service", "record_time"]


@dataclass(frozen=True)
class EventRules:
    """How raw events become service logs: SQL expressions, over a row of the events or, for targets and the status, over ``_service``.

    Targets are percentages of requests that may fail, be slow or come late; ``unit`` is how many of ``value`` make a second.
    """

    service: str = "service_name"
    time: str = "ts"
    value: str = "value"
    unit: float = 1.0
    error: str = "event_type = 'error'"
    slow: str = "value > 1"
    late: str = "false"
    error_target: str = "1D"
    response_target: str = "5D"
    response_seconds: str = "1D"
    timeliness_target: str = "5D"
    status: str = "'APPROVED'"
    timed: str = "true"


def _measures(rules: EventRules) -> dict[str, str]:
    """Counts and latency figures of one service and day; latency is in seconds."""
    return {
        "_n": "count(1)",
        "_err": f"count_if({rules.error})",
        "_slow": f"count_if({rules.slow})",
        "_late": f"count_if({rules.late})",
        "response_time_avg": f"avg({rules.value}) / {rules.unit}D",
        "response_time_min": f"min({rules.value}) / {rules.unit}D",
        "response_time_max": f"max({rules.value}) / {rules.unit}D",
    }


def in_days(events: DataFrame, rules: EventRules, start: date | None, end: date | None) -> DataFrame:
    """Events from the first moment of ``start`` to the last of ``end``, by a filter on the time column itself, which a scan can use."""
    if start is not None:
        events = events.filter(f"{rules.time} >= TIMESTAMP_NTZ '{start}'")
    if end is not None:
        events = events.filter(f"{rules.time} < TIMESTAMP_NTZ '{end + timedelta(days=1)}'")
    return events


def _period(rules: EventRules, grain: str) -> str:
    """The start of the day or hour of an event, without a detour through instants."""
    day = f"CAST(CAST({rules.time} AS DATE) AS TIMESTAMP_NTZ)"
    return {"DAY": day, "HOUR": f"timestampadd(HOUR, hour({rules.time}), {day})"}[grain]


def daily_measures(
    events: DataFrame, rules: EventRules, *, quantiles: bool = True, start: date | None = None, end: date | None = None, grain: str = "DAY"
) -> DataFrame:
    """One row per service and day, or hour."""
    rows = in_days(events, rules, start, end).selectExpr(
        "*", f"{rules.service} AS _service", f"{_period(rules, grain)} AS record_time", f"{rules.value} AS _v"
    )
    daily = aggregate(rows, _KEYS, _measures(rules))
    if not quantiles:
        return daily
    fractions = list(RESPONSE_QUANTILES.values())
    return join_on_keys(daily, spread_quantiles(rows, _KEYS, "_v", fractions, "_q"), _KEYS)


def _health(consumed: str) -> str:
    return f"CASE WHEN {consumed} >= 100 THEN '{UNHEALTHY}' WHEN {consumed} >= 80 THEN '{AT_RISK}' ELSE '{HEALTHY}' END"


def _severity(consumed: str) -> str:
    return f"CASE WHEN {consumed} >= 100 THEN '{RED}' ELSE '{GREEN}' END"


# Columns over the rows of ``daily_measures``: targets first, then the rates and used-up shares they give.
def _targets(rules: EventRules) -> dict[str, str]:
    return {
        "_target": f"CAST({rules.error_target} AS DOUBLE)",
        "_response_target": f"CAST({rules.response_target} AS DOUBLE)",
        "_timeliness_target": f"CAST({rules.timeliness_target} AS DOUBLE)",
        "_response_seconds": rules.response_seconds,
        "_status": rules.status,
        "_unit": f"{rules.unit}D",
        "_error_rate": "100D * _err / _n",
    }


_SHARES = {
    "_used": "100D * _err / (_n * _target / 100)",
    "_used_aspirational": "100D * _err / (_n * 0.6D * _target / 100)",
    "_response_used": "100D * _slow / (_n * _response_target / 100)",
    "_response_used_aspirational": "100D * _slow / (_n * 0.6D * _response_target / 100)",
    "_late_used": "100D * _late / (_n * _timeliness_target / 100)",
    "_allocated": "floor(_n * _target / 100)",
}
_ID = {
    "DAY": "concat(_category, ':', _service, ':', date_format(record_time, 'yyyy-MM-dd'))",
    "HOUR": "concat(_category, ':', _service, ':', date_format(record_time, 'yyyy-MM-dd HH'))",
}
_DERIVED = {
    "id": _ID["DAY"],
    "service_name": "_service",
    "record_time": "record_time",
    "total_count": "_n",
    "success_count": "_n - _err",
    "error_count": "_err",
    "success_rate": "100D - _error_rate",
    "error_rate": "_error_rate",
    "response_time_avg": "response_time_avg",
    "response_time_min": "response_time_min",
    "response_time_max": "response_time_max",
    "target_error_slo_perc": "_target",
    "target_response_slo_sec": "_response_seconds",
    "eb_allocated_percent": "_target",
    "eb_allocated_count": "_allocated",
    "eb_consumed_percent": "_error_rate",
    "eb_consumed_count": "_err",
    "eb_actual_consumed_percent": "_used",
    "eb_left_percent": "100D - _used",
    "eb_left_count": "_allocated - _err",
    "response_actual_consumed_percent": "_response_used",
    "response_breached": "_response_used >= 100",
    "response_breach_count": "_slow",
    "response_error_rate": "100D * _slow / _n",
    "aspirational_eb_actual_consumed_percent": "_used_aspirational",
    "aspirational_response_actual_consumed_percent": "_response_used_aspirational",
    "timeliness_consumed_percent": "_late_used",
    "timeliness_health": _health("_late_used"),
    "eb_health": _health("_used"),
    "response_health": _health("_response_used"),
    "aspirational_eb_health": _health("_used_aspirational"),
    "aspirational_response_health": _health("_response_used_aspirational"),
    "timeliness_severity": _severity("_late_used"),
    "response_severity": _severity("_response_used"),
    "eb_severity": _severity("_used"),
    "aspirational_response_severity": _severity("_response_used_aspirational"),
    "aspirational_eb_severity": _severity("_used_aspirational"),
    "burn_rate": "_error_rate / _target",
    "eb_breached": "_used >= 100",
    "eb_slo_status": "_status",
    "data_category": "_category",
    **{column: f"_q[{i}] / _unit" for i, column in enumerate(RESPONSE_QUANTILES)},
}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value)


def log_columns(daily: DataFrame, rules: EventRules, *, quantiles: bool = True, grain: str = "DAY") -> DataFrame:
    """The 83 log columns (without the percentile columns when they were not computed) of measures with a ``_category``."""
    derived = _DERIVED | {"id": _ID[grain]}
    columns = [
        f"CAST({derived.get(f.column, _literal(f.default))} AS {f.dtype}) AS {f.column}"
        for f in FIELDS
        if quantiles or f.column not in RESPONSE_QUANTILES
    ]
    return daily.selectExpr("*", *named(_targets(rules))).selectExpr("*", *named(_SHARES)).selectExpr(*columns)


def of_both_categories(daily: DataFrame, rules: EventRules) -> DataFrame:
    """Measures once per category; a service that is not timed has error-budget rows only."""
    return daily.selectExpr("*", f"explode(array('{EB}', '{RESPONSE}')) AS _category").filter(
        f"_category = '{EB}' OR ({rules.timed})"
    )


def daily_tables(
    events: DataFrame, rules: EventRules, *, quantiles: bool = True, start: date | None = None, end: date | None = None, grain: str = "DAY"
) -> SloTables:
    """Both log tables over raw events, of the days from ``start`` to ``end`` where given: a row per service and day, or with ``grain="HOUR"`` per hour.

    ``quantiles=False`` leaves out the percentile columns and with them their cost.  All three frames of the tables start
    from one aggregation of the events; ``logs`` doubles its few rows instead of reading the events twice.
    """
    daily = daily_measures(events, rules, quantiles=quantiles, start=start, end=end, grain=grain)

    def of_category(category: str, rows: DataFrame) -> DataFrame:
        return log_columns(rows.selectExpr("*", f"'{category}' AS _category"), rules, quantiles=quantiles, grain=grain)

    return SloTables(
        eb=lambda: of_category(EB, daily),
        resp=lambda: of_category(RESPONSE, daily.filter(rules.timed)),
        logs=lambda: log_columns(of_both_categories(daily, rules), rules, quantiles=quantiles, grain=grain),
    )
