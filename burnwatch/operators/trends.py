"""Risk prediction from trends, and historical statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate
from burnwatch.functions.scoring import exceeds, fixed, or_zero, or_zero_count, risk_level, sentence, words
from burnwatch.plans.quantiles import join_on_keys, spread_quantiles
from burnwatch.plans.tables import SloTables, for_service
from burnwatch.plans.trend import spread_trends

MIN_ROWS = 3
_FRACTIONS = (0.5, 0.95, 0.99)


def _near(value: str, target: str) -> str:
    return exceeds(value, f"{target} * 0.7D")


# Condition, points, code and sentence of each risk factor, over the latest record, the slopes and the spread of error rates.
_RULES: tuple[tuple[str, int, str, str], ...] = (
    (
        exceeds("error_slope", "0.1D"),
        30,
        "ERROR_TREND",
        sentence(words("Error rate trending upward (slope: "), fixed("error_slope", 3), words(")")),
    ),
    (
        exceeds("response_slope", "0.001D"),
        20,
        "RESPONSE_TREND",
        sentence(words("Response time trending upward (slope: "), fixed("response_slope", 3), words(")")),
    ),
    (
        _near("error_rate", "target_error_slo_perc"),
        25,
        "ERROR_NEAR_TARGET",
        sentence(
            words("Error rate at "), fixed("error_rate", 2), words("% (target: "), fixed("target_error_slo_perc", 2), words("%)")
        ),
    ),
    (
        _near("response_time_avg", "target_response_slo_sec"),
        25,
        "RESPONSE_NEAR_TARGET",
        sentence(
            words("Response time at "),
            fixed("response_time_avg", 3),
            words("s (target: "),
            fixed("target_response_slo_sec", 3),
            words("s)"),
        ),
    ),
    (
        exceeds("error_std", "5D"),
        15,
        "ERROR_VOLATILE",
        sentence(words("High error rate volatility (std: "), fixed("error_std", 2), words(")")),
    ),
    (
        exceeds("error_rate", "target_error_slo_perc"),
        40,
        "ERROR_VIOLATION",
        words("Currently violating error rate SLO"),
    ),
    (
        exceeds("response_time_avg", "target_response_slo_sec"),
        40,
        "RESPONSE_VIOLATION",
        words("Currently violating response time SLO"),
    ),
)


TREND_VALUES = {"error": "error_rate", "response": "response_time_avg"}
TREND_ORDER = ["record_time", "id"]
LATEST = ["error_rate", "response_time_avg", "target_error_slo_perc", "target_response_slo_sec", "total_count"]


def service_risk(tables: SloTables) -> DataFrame:
    """Risk score, level and reasons for every service with at least three records and one reason."""
    history = tables.eb.select("service_name", "record_time", "id", *LATEST)
    return judged(spread_trends(history, "service_name", TREND_ORDER, TREND_VALUES, LATEST))


def judged(found: DataFrame) -> DataFrame:
    """Risk of each service from its trends, spread and latest record."""
    frame = found.filter(f"rows >= {MIN_ROWS}").selectExpr("service_name", "error_slope", "response_slope", "error_std", "latest.*")
    score = " + ".join(f"CASE WHEN {holds} THEN {points} ELSE 0 END" for holds, points, _, _ in _RULES)
    texts = ", ".join(f"CASE WHEN {holds} THEN {text} END" for holds, _, _, text in _RULES)
    codes = ", ".join(f"CASE WHEN {holds} THEN '{code}' END" for holds, _, code, _ in _RULES)
    return (
        frame.selectExpr(
            "*",
            f"{score} AS risk_score",
            f"array_compact(array({texts})) AS risk_factors",
            f"array_compact(array({codes})) AS risk_codes",
        )
        .filter("size(risk_factors) > 0")
        .selectExpr(
            "service_name",
            f"{risk_level('risk_score')} AS risk_level",
            "risk_score",
            "risk_factors",
            "risk_codes",
            f"""struct(error_rate, response_time_avg AS response_time, {or_zero_count('total_count')} AS total_requests)
                AS current_metrics""",
            "struct(target_error_slo_perc AS error_rate_target, target_response_slo_sec AS response_time_target) AS slo_targets",
            "struct(error_slope AS error_rate_slope, response_slope AS response_time_slope) AS trends",
        )
    )


def predict_issues_today(tables: SloTables) -> DataFrame:
    """Services at high or critical risk, highest score first."""
    return (
        service_risk(tables)
        .filter(F.col("risk_level").isin("high", "critical"))
        .orderBy(F.col("risk_score").desc(), F.col("service_name").asc_nulls_last())
    )


def historical_patterns(tables: SloTables, service_name: str | None = None) -> DataFrame:
    """Statistics of error rate, latency and traffic per service over its whole history, and a map by hour of day."""
    history = for_service(tables.eb, service_name).select(
        "service_name",
        "record_time",
        "error_rate",
        "response_time_avg",
        "response_time_min",
        "response_time_max",
        "total_count",
    )
    key = ["service_name"]
    values = {"_error_q": "error_rate", "_response_q": "response_time_avg"}
    stats = {
        "data_points": "count(1)",
        "time_range": "struct(min(record_time) AS start, max(record_time) AS end)",
        "_error": _moments("error_rate", "error_rate", "error_rate"),
        "_response": _moments("response_time_avg", "response_time_min", "response_time_max"),
        "traffic_stats": f"""struct({or_zero_count('sum(total_count)')} AS total_requests,
            {or_zero('avg(total_count)')} AS avg_requests_per_period,
            {or_zero_count('max(total_count)')} AS peak_requests, {or_zero_count('min(total_count)')} AS min_requests)""",
    }
    frame = aggregate(history, key, stats)
    # Both columns take one pass: the name of the column is one more key.
    pairs = history.select("service_name", F.explode(F.create_map(*[x for c in values.values() for x in (F.lit(c), F.col(c))])).alias("_column", "_v"))
    found = spread_quantiles(pairs, [*key, "_column"], "_v", _FRACTIONS, "_q")
    for out, column in values.items():
        of_column = found.filter(F.col("_column") == column).select(*key, F.col("_q").alias(out))
        frame = join_on_keys(frame, of_column, key)
    # At most 24 rows per service reach the second aggregation.
    by_hour = aggregate(
        history.filter("record_time IS NOT NULL").selectExpr("*", "hour(record_time) AS hour"),
        [*key, "hour"],
        {
            "error_rate": "avg(error_rate)",
            "response_time_avg": "avg(response_time_avg)",
            "total_count": or_zero_count("sum(total_count)"),
        },
    )
    entry = "struct(hour, struct(error_rate, response_time_avg, total_count))"
    hourly = aggregate(by_hour, key, {"hourly_patterns": f"map_from_entries(sort_array(collect_list({entry})))"})
    return (
        join_on_keys(frame, hourly, key)
        .orderBy(F.col("service_name").asc_nulls_last())
        .selectExpr(
            "service_name",
            "data_points",
            "time_range",
            f"{_with_quantiles('_error', '_error_q')} AS error_rate_stats",
            f"{_with_quantiles('_response', '_response_q')} AS response_time_stats",
            "traffic_stats",
            "hourly_patterns",
        )
    )


def _moments(column: str, lowest: str, highest: str) -> str:
    return f"struct(avg({column}) AS mean, stddev_samp({column}) AS std, min({lowest}) AS min, max({highest}) AS max)"


def _with_quantiles(moments: str, quantiles: str) -> str:
    fields = ", ".join(f"{moments}.{name} AS {name}" for name in ("mean", "std", "min", "max"))
    return f"struct({fields}, {quantiles}[0] AS p50, {quantiles}[1] AS p95, {quantiles}[2] AS p99)"
