"""Current indicators, violations, error budgets and burn rates per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate, named, number
from burnwatch.functions.scoring import (
    at_most,
    burn_severity,
    fixed,
    or_zero_count,
    ratio_or_zero,
    sentence,
    words,
)
from burnwatch.plans.profile import eb, joined_sum, resp, service_profile
from burnwatch.plans.tables import SloTables, TimeLike, as_time, for_service, in_time_range, minutes

NO_DATA = "No data found for this service"

BUDGET_HOURS = 4
BURN_MINUTES = 30

# What the two compliance flags and the volumes need.
_COMPLIANCE = {
    "last_update": eb.max("record_time"),
    "avg_success_rate": eb.avg("success_rate"),
    "avg_error_rate": eb.avg("error_rate"),
    "avg_response_time": resp.avg("response_time_avg"),
    "_requests": eb.sum("total_count"),
    "_errors": eb.sum("error_count"),
    "error_slo_target": eb.max("target_error_slo_perc"),
    "response_slo_target": eb.max("target_response_slo_sec"),
}
_PERCENTILES = {f"avg_response_time_{p}": resp.avg(f"response_time_{p}") for p in ("p50", "p95", "p99")}
_SLI = _COMPLIANCE | _PERCENTILES

_ERROR_MET = at_most("avg_error_rate", "error_slo_target")
_RESPONSE_MET = at_most("avg_response_time", "response_slo_target")


def _volumes_and_flags(dedupe_volume: bool) -> dict[str, str]:
    return {
        "total_requests": joined_sum("_requests", dedupe_volume=dedupe_volume),
        "total_errors": joined_sum("_errors", dedupe_volume=dedupe_volume),
        "error_slo_met": _ERROR_MET,
        "response_slo_met": _RESPONSE_MET,
        "overall_slo_met": f"{_ERROR_MET} AND {_RESPONSE_MET}",
    }


def _by_volume(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("total_requests").desc_nulls_last(), F.col("service_name").asc_nulls_last())


def current_sli(tables: SloTables, service_name: str | None = None, *, dedupe_volume: bool = False) -> DataFrame:
    """Average rates, latencies, volumes and targets per service, and whether each target is met.

    Volumes count every error-budget row once per response row of the service, as a row-level join would;
    ``dedupe_volume`` counts each row once.  A service without response rows does not meet the response target.
    """
    added = _volumes_and_flags(dedupe_volume)
    return _by_volume(
        service_profile(tables, _SLI, service_name=service_name).selectExpr(
            "service_name",
            "last_update",
            "avg_success_rate",
            "avg_error_rate",
            "avg_response_time",
            *_PERCENTILES,
            *named({name: added[name] for name in ("total_requests", "total_errors")}),
            "error_slo_target",
            "response_slo_target",
            *named({name: added[name] for name in added if name.endswith("_met")}),
        )
    )


def slo_violations(tables: SloTables, *, dedupe_volume: bool = False) -> DataFrame:
    """Services that miss a target, with the reasons as codes and as sentences."""
    error_text = sentence(
        words("Error rate "), fixed("avg_error_rate", 2), words("% exceeds target "), fixed("error_slo_target", 2), words("%")
    )
    response_text = sentence(
        words("Response time "), fixed("avg_response_time", 3), words("s exceeds target "), fixed("response_slo_target", 3), words("s")
    )

    def reasons(error: str, response: str) -> str:
        return (
            f"array_compact(array(CASE WHEN NOT error_slo_met THEN {error} END,"
            f" CASE WHEN NOT response_slo_met THEN {response} END))"
        )

    return _by_volume(
        service_profile(tables, _COMPLIANCE)
        .selectExpr("*", *named(_volumes_and_flags(dedupe_volume)))
        .filter("NOT overall_slo_met")
        .selectExpr(
            "service_name",
            f"{reasons(error_text, response_text)} AS violations",
            f"{reasons(words('ERROR_RATE'), words('RESPONSE_TIME'))} AS violation_codes",
            "avg_error_rate AS error_rate",
            "avg_response_time AS response_time",
            "total_requests",
        )
    )


class _Window:
    """Sums and the latest target over error-budget rows of one time window, as conditional aggregates."""

    def __init__(self, name: str, start: Column, end: Column, *, target_is_success: bool):
        self.name = name
        self.start = start
        self.end = end
        self.rows = f"{name}_rows"
        self.target = f"{name}_target"
        self.requests = or_zero_count(f"{name}_requests")
        self.errors = or_zero_count(f"{name}_errors")
        self.allowed_percent = f"(100D - {self.target})" if target_is_success else self.target

    def marked(self, logs: DataFrame) -> DataFrame:
        """The rows with a flag column for the window; a scalar-subquery bound cannot stand inside an aggregate."""
        inside = F.expr(eb.rows) & F.col("record_time").between(self.start, self.end)
        return logs.withColumn(f"_in_{self.name}", F.coalesce(inside, F.lit(False)))

    def aggregates(self) -> dict[str, str]:
        inside = f"_in_{self.name}"
        latest = f"CASE WHEN {inside} THEN struct(record_time, id) END"
        return {
            self.rows: f"count_if({inside})",
            f"{self.name}_requests": f"sum(CASE WHEN {inside} THEN total_count END)",
            f"{self.name}_errors": f"sum(CASE WHEN {inside} THEN error_count END)",
            self.target: f"max_by(target_error_slo_perc, {latest})",
        }

    def budget_columns(self, hours: float) -> dict[str, str]:
        budget = f"({self.allowed_percent} / 100 * {self.requests})"
        return {
            "time_window_hours": number(hours),
            "total_requests": self.requests,
            "total_errors": self.errors,
            "error_slo_target_percent": self.target,
            "error_budget": budget,
            "errors_consumed": self.errors,
            "budget_remaining": f"({budget} - {self.errors})",
            "budget_consumed_percent": f"{ratio_or_zero(self.errors, budget)} * 100",
            "status": f"CASE WHEN {budget} - {self.errors} > 0 THEN 'healthy' ELSE 'budget_exceeded' END",
        }

    def burn_columns(self, window_minutes: float) -> dict[str, str]:
        actual = f"({ratio_or_zero(self.errors, self.requests)} * 100)"
        burn = ratio_or_zero(actual, self.allowed_percent)
        return {
            "time_window_minutes": number(window_minutes),
            "actual_error_rate": actual,
            "error_slo_target": self.target,
            "burn_rate": burn,
            "severity": burn_severity(burn),
            "total_requests": self.requests,
            "total_errors": self.errors,
        }

    def as_struct(self, columns: dict[str, str]) -> str:
        """The window's figures, or NULLs and an error text when the window holds no rows."""
        known = {name: f"CASE WHEN {self.rows} > 0 THEN {column} END" for name, column in columns.items()}
        known["error"] = f"CASE WHEN {self.rows} = 0 THEN '{NO_DATA}' END"
        return "named_struct(" + ", ".join(f"'{name}', {column}" for name, column in known.items()) + ")"


def _anchor(as_of: TimeLike) -> Column:
    """End of the window: the wall clock unless the caller gives a time."""
    return F.localtimestamp() if as_of is None else as_time(as_of)


def error_budget(
    tables: SloTables,
    service_name: str | None = None,
    time_window_hours: float = BUDGET_HOURS,
    *,
    as_of: TimeLike = None,
    target_is_success: bool = False,
) -> DataFrame:
    """Error budget of each service over the window ending at ``as_of`` (both ends inclusive).

    The budget is target/100 of the requests; ``target_is_success`` reads the target as a success rate instead.
    """
    end = _anchor(as_of)
    window = _Window("w", end - minutes(time_window_hours * 60), end, target_is_success=target_is_success)
    return _windowed(tables, service_name, window).selectExpr(
        "service_name", *named(window.budget_columns(time_window_hours))
    )


def burn_rate(
    tables: SloTables,
    service_name: str | None = None,
    time_window_minutes: float = BURN_MINUTES,
    *,
    as_of: TimeLike = None,
    target_is_success: bool = False,
) -> DataFrame:
    """Observed error rate over the allowed one, per service, over the window ending at ``as_of``."""
    end = _anchor(as_of)
    window = _Window("w", end - minutes(time_window_minutes), end, target_is_success=target_is_success)
    return _windowed(tables, service_name, window).selectExpr(
        "service_name", *named(window.burn_columns(time_window_minutes))
    )


def _windowed(tables: SloTables, service_name: str | None, window: _Window) -> DataFrame:
    rows = in_time_range(for_service(tables.eb, service_name), window.start, window.end)
    return aggregate(window.marked(rows), ["service_name"], window.aggregates())


def service_summary(
    tables: SloTables,
    service_name: str | None = None,
    *,
    budget_hours: float = BUDGET_HOURS,
    burn_minutes: float = BURN_MINUTES,
    as_of: TimeLike = None,
    target_is_success: bool = False,
    dedupe_volume: bool = False,
) -> DataFrame:
    """Indicators, targets, compliance, error budget and burn rate of each service in one nested row.

    All of it comes from one aggregation: both windows are conditional aggregates beside the indicators.
    A service without rows in a window has an ``error`` text and NULLs in that struct.
    """
    end = _anchor(as_of)
    budget = _Window("budget", end - minutes(budget_hours * 60), end, target_is_success=target_is_success)
    burn = _Window("burn", end - minutes(burn_minutes), end, target_is_success=target_is_success)
    profile = service_profile(
        tables,
        _SLI | budget.aggregates() | burn.aggregates(),
        service_name=service_name,
        prepare=lambda logs: burn.marked(budget.marked(logs)),
    )
    return profile.selectExpr("*", *named(_volumes_and_flags(dedupe_volume))).selectExpr(
        "service_name",
        """struct(avg_success_rate AS success_rate, avg_error_rate AS error_rate, avg_response_time AS response_time_avg,
           avg_response_time_p50 AS response_time_p50, avg_response_time_p95 AS response_time_p95,
           avg_response_time_p99 AS response_time_p99, total_requests) AS sli""",
        "struct(error_slo_target AS error_rate_target, response_slo_target AS response_time_target) AS slo_targets",
        "struct(error_slo_met, response_slo_met, overall_slo_met) AS slo_compliance",
        f"{budget.as_struct(budget.budget_columns(budget_hours))} AS error_budget",
        f"{burn.as_struct(burn.burn_columns(burn_minutes))} AS burn_rate",
    )
