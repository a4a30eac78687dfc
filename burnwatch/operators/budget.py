"""Budget exhaustion, and breach rate against error rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate
from burnwatch.functions.scoring import or_zero, or_zero_count
from burnwatch.plans.profile import eb, resp, service_profile
from burnwatch.plans.tables import SloTables


def breach_vs_error_analysis(tables: SloTables, service_name: str | None = None) -> DataFrame:
    """Whether a service is rather slow (breaches above errors) or rather broken (errors above breaches)."""
    services = service_profile(
        tables,
        {
            "_breach_rate": resp.avg("response_error_rate"),
            "_error_rate": eb.avg("error_rate"),
            "_breaches": resp.avg("response_breach_count"),
            "_errors": eb.avg("error_count"),
            "_p95": resp.avg("response_time_p95"),
        },
        service_name=service_name,
    )
    return services.orderBy(
        F.col("_breach_rate").desc_nulls_last(), F.col("service_name").asc_nulls_last()
    ).selectExpr(
        "service_name",
        f"{or_zero('_breach_rate')} AS avg_breach_rate",
        f"{or_zero('_error_rate')} AS avg_error_rate",
        f"{or_zero_count('_breaches')} AS avg_breach_count",
        f"{or_zero_count('_errors')} AS avg_error_count",
        f"{or_zero('_p95')} AS avg_p95",
        """CASE WHEN _breach_rate > _error_rate THEN 'LATENCY_ISSUE'
           WHEN _error_rate > _breach_rate THEN 'RELIABILITY_ISSUE' ELSE 'BALANCED' END AS issue_type""",
    )


def budget_exhausted_services(tables: SloTables) -> DataFrame:
    """Budget states at or over 100 % or with a negative rest, each distinct state once."""
    state = [
        "service_name",
        "eb_actual_consumed_percent",
        "eb_left_count",
        "aspirational_eb_actual_consumed_percent",
        "burn_rate",
        "eb_health",
    ]
    exhausted = tables.eb.filter("eb_actual_consumed_percent >= 100 OR eb_left_count < 0")
    return (
        aggregate(exhausted, state, {"_error_rate": "avg(error_rate)"})
        .orderBy(F.col("eb_actual_consumed_percent").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in state])
        .selectExpr(
            "service_name",
            f"{or_zero('eb_actual_consumed_percent')} AS eb_actual_consumed_percent",
            f"{or_zero_count('eb_left_count')} AS eb_left_count",
            f"{or_zero('aspirational_eb_actual_consumed_percent')} AS aspirational_eb_actual_consumed_percent",
            f"{or_zero('burn_rate')} AS burn_rate",
            "coalesce(eb_health, 'UNKNOWN') AS eb_health",
            f"{or_zero('_error_rate')} AS avg_error_rate",
        )
    )
