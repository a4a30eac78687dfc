"""Fleet health, composite scores, gaps, severity and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate, named
from burnwatch.functions.health import colour_count, healthy_count, worst_health
from burnwatch.functions.scoring import or_zero, or_zero_count, ratio_or_zero
from burnwatch.plans.profile import eb, joined_sum, resp, service_profile
from burnwatch.plans.tables import SloTables
from burnwatch.schema import AT_RISK, GREEN, HEALTHY, RED, UNHEALTHY


def service_health_overview(tables: SloTables, *, dedupe_volume: bool = False) -> DataFrame:
    """One row: how many services are in each health state, fleet volume and error rate."""
    services = service_profile(
        tables,
        {
            "eb_health": eb.worst("eb_health"),
            "response_health": resp.worst("response_health"),
            "_requests": eb.sum("total_count"),
            "_errors": eb.sum("error_count"),
        },
    )
    requests = joined_sum("_requests", dedupe_volume=dedupe_volume)
    errors = joined_sum("_errors", dedupe_volume=dedupe_volume)
    totals = aggregate(
        services,
        [],
        {
            "total_services": "count(1)",
            "eb_healthy_services": f"count_if(eb_health = '{HEALTHY}')",
            "eb_at_risk_services": f"count_if(eb_health = '{AT_RISK}')",
            "eb_unhealthy_services": f"count_if(eb_health NOT IN ('{HEALTHY}', '{AT_RISK}'))",
            "response_healthy_services": f"count_if(response_health = '{HEALTHY}')",
            "response_unhealthy_services": f"count_if(response_health <> '{HEALTHY}')",
            "total_requests": or_zero(f"sum({requests})"),
            "total_errors": or_zero(f"sum({errors})"),
        },
    )
    return totals.selectExpr(
        "total_services",
        "eb_healthy_services",
        "eb_at_risk_services",
        "eb_unhealthy_services",
        "response_healthy_services",
        "response_unhealthy_services",
        "eb_healthy_services AS healthy_services",
        "eb_at_risk_services AS degraded_services",
        "eb_unhealthy_services AS violated_services",
        "eb_unhealthy_services AS unhealthy_services",
        "total_requests",
        "total_errors",
        f"{ratio_or_zero('total_errors', 'total_requests')} * 100 AS overall_error_rate",
        f"{ratio_or_zero('eb_healthy_services', 'total_services')} * 100 AS health_percentage",
    )


def aspirational_slo_gap(tables: SloTables) -> DataFrame:
    """Services healthy against the standard target and unhealthy against the aspirational one."""
    services = service_profile(
        tables,
        {
            "eb_health": eb.worst("eb_health"),
            "aspirational_eb_health": eb.worst("aspirational_eb_health"),
            "response_health": resp.worst("response_health"),
            "aspirational_response_health": resp.worst("aspirational_response_health"),
            "_standard": eb.avg("eb_actual_consumed_percent"),
            "_aspirational": eb.avg("aspirational_eb_actual_consumed_percent"),
            "_burn": eb.avg("burn_rate"),
        },
    )
    gap = " OR ".join(
        f"({side}_health = '{HEALTHY}' AND aspirational_{side}_health = '{UNHEALTHY}')" for side in ("eb", "response")
    )
    return services.filter(gap).selectExpr(
        "service_name",
        "eb_health",
        "aspirational_eb_health",
        "response_health",
        "aspirational_response_health",
        f"{or_zero('_standard')} AS std_eb_consumed",
        f"{or_zero('_aspirational')} AS asp_eb_consumed",
        f"{or_zero('_burn')} AS avg_burn_rate",
    )


def timeliness_issues(tables: SloTables) -> DataFrame:
    """Services with unhealthy timeliness, split by the response health recorded on the same rows."""
    return aggregate(
        tables.eb.filter(f"timeliness_health = '{UNHEALTHY}'"),
        ["service_name", "timeliness_health", "response_health"],
        {
            "avg_timeliness_consumed": or_zero("avg(timeliness_consumed_percent)"),
            "avg_p95": or_zero("avg(response_time_p95)"),
            "avg_error_rate": or_zero("avg(error_rate)"),
        },
    )


def composite_health_score(tables: SloTables) -> DataFrame:
    """Share of five health dimensions that are HEALTHY, worst services first."""
    dimensions = {
        "eb_health": eb,
        "response_health": resp,
        "timeliness_health": eb,
        "aspirational_eb_health": eb,
        "aspirational_response_health": resp,
    }
    worst = {name: side.worst(name) for name, side in dimensions.items()}
    services = service_profile(tables, worst | {"_burn": eb.avg("burn_rate")})
    return (
        services.selectExpr("*", f"{healthy_count(list(dimensions))} AS healthy_dimensions")
        .orderBy(
            F.col("healthy_dimensions").asc_nulls_last(),
            F.col("_burn").desc_nulls_last(),
            F.col("service_name").asc_nulls_last(),
        )
        .selectExpr(
            "service_name",
            "healthy_dimensions",
            "healthy_dimensions / 5D * 100 AS health_score",
            *dimensions,
            f"{or_zero('_burn')} AS avg_burn_rate",
        )
    )


def severity_heatmap(tables: SloTables) -> DataFrame:
    """Red and green counts for every combination of severity colours seen for a service.

    Both sides are reduced to their distinct colour combinations first, so the join handles combinations, not rows.
    """
    budget = aggregate(
        tables.eb,
        ["service_name", "eb_severity", "timeliness_severity", "aspirational_eb_severity"],
        {"_burn": "avg(burn_rate)"},
    )
    response = tables.resp.select("service_name", "response_severity", "aspirational_response_severity").distinct()
    severities = [
        "response_severity",
        "eb_severity",
        "timeliness_severity",
        "aspirational_response_severity",
        "aspirational_eb_severity",
    ]
    counts = {"red_count": colour_count(RED, severities), "green_count": colour_count(GREEN, severities)}
    return (
        budget.join(response, "service_name", "left")
        .selectExpr("*", *named(counts))
        .orderBy(
            F.col("red_count").desc(),
            F.col("_burn").desc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in ("service_name", *severities)],
        )
        .selectExpr(
            "service_name",
            "red_count",
            "green_count",
            "response_severity",
            "eb_severity",
            "timeliness_severity",
            f"{or_zero('_burn')} AS avg_burn_rate",
        )
    )


def slo_governance_status(tables: SloTables) -> DataFrame:
    """Services whose worst budget health is not HEALTHY, graded by it and by their average burn rate."""
    services = aggregate(
        tables.eb,
        ["service_name"],
        {
            "_burn": "avg(burn_rate)",
            "eb_health": worst_health("eb_health"),
            "response_health": worst_health("response_health"),
            "eb_breached": "coalesce(bool_or(eb_breached), false)",
            "_left": "avg(eb_left_percent)",
        },
    )
    status = f"""CASE WHEN eb_health = '{UNHEALTHY}' AND _burn > 5 THEN 'CRITICAL'
        WHEN eb_health = '{UNHEALTHY}' THEN 'NEEDS_REVIEW' WHEN eb_health = '{AT_RISK}' THEN 'AT_RISK' ELSE 'HEALTHY' END"""
    return (
        services.filter(f"eb_health IN ('{UNHEALTHY}', '{AT_RISK}')")
        .orderBy(F.col("_burn").desc_nulls_last(), F.col("service_name").asc_nulls_last())
        .selectExpr(
            "service_name",
            f"{status} AS governance_status",
            f"{or_zero('_burn')} AS avg_burn_rate",
            "eb_health",
            "response_health",
            "eb_breached",
            f"{or_zero('_left')} AS eb_left_percent",
        )
    )


def services_by_slo_status(tables: SloTables) -> DataFrame:
    """How many error-budget rows carry each declared approval status."""
    return aggregate(tables.eb, ["eb_slo_status"], {"records": "count(1)"})
