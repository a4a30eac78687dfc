"""The analytics functions by name, and their results as JSON rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.operators import budget, degradation, health, rankings, sli, trends
from burnwatch.plans.tables import SloTables

# Function names of the query interface.
FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "get_degrading_services": degradation.degrading_services,
    "get_current_sli": sli.current_sli,
    "get_slo_violations": sli.slo_violations,
    "get_service_health_overview": health.service_health_overview,
    "get_top_services_by_volume": rankings.top_services_by_volume,
    "get_slowest_services": rankings.slowest_services,
    "get_error_prone_services": rankings.error_prone_services,
    "calculate_error_budget": sli.error_budget,
    "get_service_summary": sli.service_summary,
    "predict_issues_today": trends.predict_issues_today,
    "get_volume_trends": degradation.volume_trends,
    "get_historical_patterns": trends.historical_patterns,
    "get_services_by_burn_rate": rankings.services_by_burn_rate,
    "get_aspirational_slo_gap": health.aspirational_slo_gap,
    "get_timeliness_issues": health.timeliness_issues,
    "get_breach_vs_error_analysis": budget.breach_vs_error_analysis,
    "get_budget_exhausted_services": budget.budget_exhausted_services,
    "get_composite_health_score": health.composite_health_score,
    "get_severity_heatmap": health.severity_heatmap,
    "get_slo_governance_status": health.slo_governance_status,
}

#: What a function says of a service without data, where it is not the common text.
NO_DATA = dict.fromkeys(("get_volume_trends", "get_historical_patterns"), "No data found for service {service}")


def run(name: str, tables: SloTables, **parameters: Any) -> DataFrame:
    """Run a function by name; per-service functions cover all services unless ``service_name`` is given."""
    if name not in FUNCTIONS:
        raise KeyError(f"Unknown function: {name}; known: {', '.join(sorted(FUNCTIONS))}")
    return FUNCTIONS[name](tables, **parameters)


def ask(name: str, tables: SloTables, services: str | Sequence[str], **parameters: Any) -> DataFrame:
    """A per-service function for the services asked for, in one job, with a record for each: where there is no data, one with an ``error`` text."""
    asked = [services] if isinstance(services, str) else list(services)
    wanted = F.col("service_name").isin(asked)
    chosen = SloTables.from_pair(tables.eb.filter(wanted), tables.resp.filter(wanted), tables.newest_day)
    if parameters.get("as_of") is None and name == "get_volume_trends":
        # The window ends at the newest record of all services.
        parameters["as_of"] = tables.latest_time()
    return answered(run(name, chosen, **parameters), asked, NO_DATA.get(name, sli.NO_DATA))


def answered(result: DataFrame, services: Sequence[str], text: str = sli.NO_DATA) -> DataFrame:
    """The result's rows of the services, and a row for each other one with NULLs and an ``error``; the text may name the ``{service}``.

    The names asked for are joined to the rows; a result that has an ``error`` column keeps it.
    """
    spark = result.sparkSession
    names = spark.createDataFrame([(s, text.format(service=s)) for s in dict.fromkeys(services)], "service_name string, _none string")
    columns = [c for c in result.columns if c != "error"]
    found = result.withColumn("_found", F.lit(True))
    error = F.when(F.col("_found").isNull(), F.col("_none"))
    if "error" in result.columns:
        error = F.coalesce("error", error)
    return names.join(found, "service_name", "left").select(*columns, error.alias("error"))


def json_rows(result: DataFrame) -> DataFrame:
    """One JSON text per row in column ``value``: ISO timestamps, NULLs kept, NaN as null."""
    columns = [
        F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in result.schema
    ]
    return result.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
