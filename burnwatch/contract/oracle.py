"""SQL for the registered queries, over the same tables, in join-then-aggregate form.

The log tables are derived from ``events`` by a prelude of common table expressions.  ``eb`` and ``resp`` hold the two
tables and ``joined`` their left join by service name, row by row, so the sums show the row product.
"""

from __future__ import annotations

from burnwatch.contract.queries import CLEAR_AT, DIGITS, LATENCY_DIGITS, RAISE_AT, RUN_PAGES, SERVICE, WEEK_MINUTES, digits
from burnwatch.schema import FIELDS, RESPONSE_QUANTILES
from burnwatch.sources.pages import PAGE_SIZE


def r(expression: str, name: str, places: int = DIGITS) -> str:
    return f"round({expression}, {places}) AS {name}"


def lat(expression: str, name: str) -> str:
    return r(expression, name, LATENCY_DIGITS)


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def volume(expression: str, name: str) -> str:
    """A sum that the row product multiplies; DuckDB adds integers in 128 bits."""
    return f"CAST({expression} AS DOUBLE) AS {name}"


def health(consumed: str) -> str:
    return f"CASE WHEN {consumed} >= 100 THEN 'UNHEALTHY' WHEN {consumed} >= 80 THEN 'AT_RISK' ELSE 'HEALTHY' END"


def severity(consumed: str) -> str:
    return f"CASE WHEN {consumed} >= 100 THEN '#FD346E' ELSE '#07AE86' END"


def worst(column: str) -> str:
    """One unhealthy row is enough, else one at risk; anything else counts as healthy."""
    return (
        f"if(coalesce(bool_or({column} = 'UNHEALTHY'), false), 'UNHEALTHY',"
        f" if(coalesce(bool_or({column} = 'AT_RISK'), false), 'AT_RISK', 'HEALTHY'))"
    )


# Literals such as 2e1 are DOUBLE in both engines; plain decimals would be DECIMAL.
_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

_DERIVED = {
    "service_name": "service_name",
    "record_time": "record_time",
    "total_count": "n",
    "success_count": "n - err",
    "error_count": "err",
    "success_rate": "1e2 - error_rate",
    "error_rate": "error_rate",
    "response_time_avg": "rt_avg",
    "response_time_min": "rt_min",
    "response_time_max": "rt_max",
    "target_error_slo_perc": "t",
    "target_response_slo_sec": "46e-2 + 2e-2 * (k % 5)",
    "eb_allocated_percent": "t",
    "eb_allocated_count": "floor(n * t / 100)",
    "eb_consumed_percent": "error_rate",
    "eb_consumed_count": "err",
    "eb_actual_consumed_percent": "used",
    "eb_left_percent": "1e2 - used",
    "eb_left_count": "floor(n * t / 100) - err",
    "response_actual_consumed_percent": "r_used",
    "response_breached": "r_used >= 100",
    "response_breach_count": "slow",
    "response_error_rate": "1e2 * slow / n",
    "aspirational_eb_actual_consumed_percent": "a_used",
    "aspirational_response_actual_consumed_percent": "ar_used",
    "timeliness_consumed_percent": "l_used",
    "timeliness_health": health("l_used"),
    "eb_health": health("used"),
    "response_health": health("r_used"),
    "aspirational_eb_health": health("a_used"),
    "aspirational_response_health": health("ar_used"),
    "timeliness_severity": severity("l_used"),
    "response_severity": severity("r_used"),
    "eb_severity": severity("used"),
    "aspirational_response_severity": severity("ar_used"),
    "aspirational_eb_severity": severity("a_used"),
    "burn_rate": "error_rate / t",
    "eb_breached": "used >= 100",
    "eb_slo_status": "CASE WHEN k % 2 = 0 THEN 'APPROVED' ELSE 'UNDER_REVIEW' END",
    **{column: f"q{round(p * 100)}" for column, p in RESPONSE_QUANTILES.items()},
}


def _log_columns(category: str) -> str:
    out = []
    for f in FIELDS:
        if f.column == "id":
            value = f"'{category}:' || service_name || ':' || strftime(record_time, '%Y-%m-%d')"
        elif f.column == "data_category":
            value = f"'{category}'"
        elif f.column in _DERIVED:
            value = _DERIVED[f.column]
        elif f.default is None:
            value = "NULL"
        else:
            value = f"'{f.default}'"
        out.append(f"CAST({value} AS {_SQL_TYPES[f.dtype]}) AS {f.column}")
    return ", ".join(out)


_QUANTILE_COLUMNS = ", ".join(f"quantile_cont(value / 100, {p}) AS q{round(p * 100)}" for p in RESPONSE_QUANTILES.values())

PRELUDE = f"""
WITH counted AS (
  SELECT user_id % 10 AS k, CAST(date_trunc('day', ts) AS TIMESTAMP) AS record_time, count(*) AS n,
         count(*) FILTER (event_type = 'error') AS err, count(*) FILTER (value > 100) AS slow,
         count(*) FILTER (hour(ts) >= 18) AS late,
         avg(value) / 100 AS rt_avg, min(value) / 100 AS rt_min, max(value) / 100 AS rt_max,
         {_QUANTILE_COLUMNS}
  FROM events GROUP BY ALL
), targeted AS (
  SELECT *, 'svc_' || k AS service_name, 2e1 + 6 * (k % 5) AS t, 14e0 + 6 * (k % 4) AS tr, 3e1 + 20 * (k % 3) AS tt,
         1e2 * err / n AS error_rate
  FROM counted
), daily AS (
  SELECT *, 1e2 * err / (n * t / 100) AS used, 1e2 * err / (n * 6e-1 * t / 100) AS a_used,
         1e2 * slow / (n * tr / 100) AS r_used, 1e2 * slow / (n * 6e-1 * tr / 100) AS ar_used,
         1e2 * late / (n * tt / 100) AS l_used
  FROM targeted
), eb AS (
  SELECT {_log_columns("EB")} FROM daily
), resp AS (
  SELECT {_log_columns("RESPONSE")} FROM daily WHERE service_name <> 'svc_9'
)
"""

# The same by the hour.
HOURS = PRELUDE.replace("date_trunc('day', ts)", "date_trunc('hour', ts)").replace("'%Y-%m-%d'", "'%Y-%m-%d %H'")

_JOIN = "FROM eb e LEFT JOIN resp r ON e.service_name = r.service_name"

_SLI = f"""
  SELECT e.service_name, max(e.record_time) AS last_update, avg(e.success_rate) AS avg_success_rate,
         avg(e.error_rate) AS avg_error_rate, avg(r.response_time_avg) AS avg_response_time,
         avg(r.response_time_p50) AS p50, avg(r.response_time_p95) AS p95, avg(r.response_time_p99) AS p99,
         sum(e.total_count) AS total_requests, sum(e.error_count) AS total_errors,
         max(e.target_error_slo_perc) AS error_slo_target, max(e.target_response_slo_sec) AS response_slo_target
  {_JOIN} GROUP BY e.service_name
"""
_ERROR_MET = "coalesce(avg_error_rate <= error_slo_target, FALSE)"
_RESPONSE_MET = "coalesce(avg_response_time <= response_slo_target, FALSE)"

_SLI_SELECT = f"""
SELECT service_name, last_update, {r("avg_success_rate", "avg_success_rate")}, {r("avg_error_rate", "avg_error_rate")},
       {lat("avg_response_time", "avg_response_time")}, {lat("p50", "avg_response_time_p50")},
       {lat("p95", "avg_response_time_p95")}, {lat("p99", "avg_response_time_p99")},
       {volume("total_requests", "total_requests")}, {volume("total_errors", "total_errors")},
       {r("error_slo_target", "error_slo_target")}, {lat("response_slo_target", "response_slo_target")},
       {_ERROR_MET} AS error_slo_met, {_RESPONSE_MET} AS response_slo_met,
       {_ERROR_MET} AND {_RESPONSE_MET} AS overall_slo_met
FROM sli
"""


def _window_sums(name: str, hours: int) -> str:
    return f""", {name} AS (
  SELECT service_name, sum(total_count) AS requests, sum(error_count) AS errors,
         arg_max(target_error_slo_perc, record_time) AS target
  FROM eb, (SELECT max(record_time) AS latest FROM eb) m
  WHERE record_time BETWEEN latest - INTERVAL {hours} HOUR AND latest
  GROUP BY service_name)
"""


def _budget_select(prefix: str = "", source: str = "") -> str:
    q, e, t = f"{source}requests", f"{source}errors", f"{source}target"
    budget = f"({t} / 100 * {q})"
    return f"""CAST(168 AS INTEGER) AS {prefix}time_window_hours, {big(q, prefix + "total_requests")}, {big(e, prefix + "total_errors")},
       {r(t, prefix + "error_slo_target_percent")}, {r(budget, prefix + "error_budget")}, {big(e, prefix + "errors_consumed")},
       {r(f"{budget} - {e}", prefix + "budget_remaining")},
       {r(f"CASE WHEN {budget} > 0 THEN {e} / {budget} * 100 ELSE 0 END", prefix + "budget_consumed_percent")},
       CASE WHEN {budget} - {e} > 0 THEN 'healthy' ELSE 'budget_exceeded' END AS {prefix}status"""


def _burn_select(prefix: str = "", source: str = "") -> str:
    q, e, t = f"{source}requests", f"{source}errors", f"{source}target"
    actual = f"(CASE WHEN {q} > 0 THEN 1e2 * {e} / {q} ELSE 0 END)"
    burn = f"(CASE WHEN {t} > 0 THEN {actual} / {t} ELSE 0 END)"
    return f"""CAST({WEEK_MINUTES} AS INTEGER) AS {prefix}time_window_minutes, {r(actual, prefix + "actual_error_rate")},
       {r(t, prefix + "error_slo_target")}, {r(burn, prefix + "burn_rate")},
       CASE WHEN {burn} < 1 THEN 'healthy' WHEN {burn} < 2 THEN 'warning' WHEN {burn} < 10 THEN 'critical'
            ELSE 'emergency' END AS {prefix}severity,
       {big(q, prefix + "total_requests")}, {big(e, prefix + "total_errors")}"""


_METRICS = {
    "error_rate": "error_rate",
    "response_time": "response_time_avg",
    "response_time_p95": "response_time_p95",
    "response_time_p99": "response_time_p99",
}


def _two_windows() -> str:
    averages = ", ".join(f"avg({column}) AS {metric}" for metric, column in _METRICS.items())
    parts = []
    for name, condition in (
        ("recent", f"record_time >= latest - INTERVAL {WEEK_MINUTES} MINUTE AND record_time <= latest"),
        (
            "base",
            f"record_time >= latest - INTERVAL {2 * WEEK_MINUTES} MINUTE"
            f" AND record_time < latest - INTERVAL {WEEK_MINUTES} MINUTE",
        ),
    ):
        parts.append(
            f""", {name} AS (SELECT service_name, {averages}, sum(total_count) AS requests, sum(error_count) AS errors
  FROM eb, (SELECT max(record_time) AS latest FROM eb) m WHERE {condition} GROUP BY service_name)"""
        )
    changes = ", ".join(
        f"CASE WHEN b.{m} = 0 THEN CASE WHEN c.{m} > 0 THEN 1e2 ELSE 0 END ELSE (c.{m} - b.{m}) / b.{m} * 100 END AS {m}_change"
        for m in _METRICS
    )
    values = ", ".join(f"c.{m} AS {m}_recent, b.{m} AS {m}_base" for m in _METRICS)
    return "".join(parts) + (
        f", compared AS (SELECT c.service_name, {values}, {changes}, c.requests, c.errors"
        " FROM recent c JOIN base b ON c.service_name = b.service_name)"
    )


def _degrading() -> str:
    columns = ", ".join(
        ", ".join(
            (
                (r if m == "error_rate" else lat)(f"{m}_recent", f"{m}_recent"),
                (r if m == "error_rate" else lat)(f"{m}_base", f"{m}_baseline"),
                r(f"{m}_change", f"{m}_change_percent"),
            )
        )
        for m in _METRICS
    )
    largest = "greatest(" + ", ".join(f"{m}_change" for m in _METRICS) + ")"
    return f"""{PRELUDE}{_two_windows()}
SELECT service_name, {columns}, {big("requests", "total_requests_recent")}, {big("errors", "total_errors_recent")},
       CASE WHEN {largest} > 100 THEN 'critical' WHEN {largest} > 50 THEN 'warning' ELSE 'minor' END AS severity
FROM compared WHERE {largest} > 5
"""


_WEEK_ROWS = f"""
FROM eb, (SELECT max(record_time) AS latest FROM eb) m
WHERE record_time BETWEEN latest - INTERVAL {WEEK_MINUTES} MINUTE AND latest
"""

_VOLUME_SUMMARY = f"""
  SELECT service_name, {big("sum(total_count)", "total_volume")}, {big("sum(error_count)", "total_errors")},
         {r("avg(error_rate)", "avg_error_rate")}, {lat("avg(response_time_avg)", "avg_response_time")}
  {_WEEK_ROWS} GROUP BY service_name
"""


def _risk(only_high: bool, prelude: str = PRELUDE) -> str:
    rules = [
        ("error_slope > 0.1", 30, "ERROR_TREND"),
        ("response_slope > 0.001", 20, "RESPONSE_TREND"),
        ("err > target * 7e-1", 25, "ERROR_NEAR_TARGET"),
        ("rt > response_target * 7e-1", 25, "RESPONSE_NEAR_TARGET"),
        ("sd > 5", 15, "ERROR_VOLATILE"),
        ("err > target", 40, "ERROR_VIOLATION"),
        ("rt > response_target", 40, "RESPONSE_VIOLATION"),
    ]
    score = " + ".join(f"CASE WHEN {c} THEN {points} ELSE 0 END" for c, points, _ in rules)
    codes = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, _, code in rules)
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _, _ in rules)
    keep = "score >= 50" if only_high else "n > 0"
    return f"""{prelude}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY record_time, id) AS i FROM eb
), fitted AS (
  SELECT service_name, count(*) AS n_rows, regr_slope(error_rate, i) AS error_slope,
         regr_slope(response_time_avg, i) AS response_slope, stddev_samp(error_rate) AS sd,
         arg_max(error_rate, i) AS err, arg_max(response_time_avg, i) AS rt, arg_max(target_error_slo_perc, i) AS target,
         arg_max(target_response_slo_sec, i) AS response_target, arg_max(total_count, i) AS requests
  FROM numbered GROUP BY service_name HAVING count(*) >= 3
), scored AS (
  SELECT *, {score} AS score, concat_ws('|', {codes}) AS codes, {n} AS n FROM fitted
)
SELECT service_name, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium'
            ELSE 'low' END AS risk_level,
       {big("score", "risk_score")}, codes AS risk_codes, {big("n", "n_factors")},
       {r("err", "current_metrics_error_rate")}, {lat("rt", "current_metrics_response_time")},
       {big("requests", "current_metrics_total_requests")}, {r("target", "slo_targets_error_rate_target")},
       {lat("response_target", "slo_targets_response_time_target")}, {r("error_slope", "trends_error_rate_slope")},
       {r("response_slope", "trends_response_time_slope")}
FROM scored WHERE {keep}
"""


def _moments(prefix: str, column: str, low: str, high: str, rounding) -> str:
    return ", ".join(
        (
            rounding(f"avg({column})", f"{prefix}_mean"),
            rounding(f"stddev_samp({column})", f"{prefix}_std"),
            rounding(f"min({low})", f"{prefix}_min"),
            rounding(f"max({high})", f"{prefix}_max"),
        )
    )


def _stats(prefix: str, column: str, low: str, high: str, rounding) -> str:
    # Latency places follow the column name: p50, p95 and p99 of either prefix are latency-named.
    return ", ".join(
        (
            rounding(f"avg({column})", f"{prefix}_mean"),
            rounding(f"stddev_samp({column})", f"{prefix}_std"),
            rounding(f"min({low})", f"{prefix}_min"),
            rounding(f"max({high})", f"{prefix}_max"),
            lat(f"quantile_cont({column}, 0.5)", f"{prefix}_p50"),
            lat(f"quantile_cont({column}, 0.95)", f"{prefix}_p95"),
            lat(f"quantile_cont({column}, 0.99)", f"{prefix}_p99"),
        )
    )


def _plain_logs() -> str:
    out = []
    for f in FIELDS:
        if f.dtype != "double":
            out.append(f.column)
        else:
            out.append(r(f.column, f.column, digits(f.column)))
    return ", ".join(out)


_FIVE_HEALTHS = (
    ("eb_health", "e"),
    ("response_health", "r"),
    ("timeliness_health", "e"),
    ("aspirational_eb_health", "e"),
    ("aspirational_response_health", "r"),
)
_FOUR_HEALTHS = tuple(h for h in _FIVE_HEALTHS if h[0] != "timeliness_health")


def _worst_columns(healths) -> str:
    return ", ".join(f"{worst(f'{side}.{name}')} AS {name}" for name, side in healths)


def _composite() -> str:
    dims = " + ".join(f"CASE WHEN {name} = 'HEALTHY' THEN 1 ELSE 0 END" for name, _ in _FIVE_HEALTHS)
    return f"""{PRELUDE}, s AS (
  SELECT e.service_name, {_worst_columns(_FIVE_HEALTHS)}, avg(e.burn_rate) AS burn {_JOIN} GROUP BY e.service_name)
SELECT service_name, {big(dims, "healthy_dimensions")}, {r(f"({dims}) / 5e0 * 100", "health_score")},
       {", ".join(name for name, _ in _FIVE_HEALTHS)}, {r("burn", "avg_burn_rate")}
FROM s
"""


def _colours(colour: str) -> str:
    columns = (
        "r.response_severity",
        "e.eb_severity",
        "e.timeliness_severity",
        "r.aspirational_response_severity",
        "e.aspirational_eb_severity",
    )
    return " + ".join(f"CASE WHEN {c} = '{colour}' THEN 1 ELSE 0 END" for c in columns)


# Items of the ingest queries, as relations: the text members of queries.event_pages in typed form.
_INGEST = f"""
WITH item AS (
  SELECT event_id AS n, event_id // {PAGE_SIZE} AS page_id, event_id % {PAGE_SIZE} AS pos, *,
         event_id % 11 <> 0 AS has_key, event_id % 11 <> 0 OR event_id % 3 <> 0 AS has_sid
  FROM events WHERE event_id % 31 <> 0
), faulty AS (
  SELECT *, concat_ws('|',
    CASE WHEN n % 29 = 0 THEN 'avgPercentiles' END,
    CASE WHEN n % 23 = 0 THEN 'errorCount' END,
    CASE WHEN n % 13 = 0 THEN 'totalCount' END) AS bad_keys
  FROM item
), typed AS (
  SELECT CASE WHEN has_key THEN 'rec_' || (n // 3) ELSE 'platform_' || n END AS id,
         CASE WHEN has_sid THEN n END AS sid,
         CASE WHEN n % 19 <> 0 THEN 'svc_' || (user_id % 10) END AS service_name,
         CASE WHEN n % 17 <> 0 THEN n % 1000 ELSE 0 END AS total_count,
         n % 7 AS error_count, value AS error_rate,
         value / CASE WHEN n % 17 <> 0 THEN greatest(n % 1000, 1) ELSE 1 END AS response_time_max,
         value AS response_time_p95,
         CASE WHEN value > 150 THEN 'UNHEALTHY' WHEN n % 5 = 0 THEN 'None' ELSE 'HEALTHY' END AS eb_health,
         value / 50 AS burn_rate, n % 2 = 0 AS eb_breached,
         CASE WHEN n % 3 <> 0 THEN n ELSE 0 END AS project_id,
         CASE event_type WHEN 'error' THEN 'RESPONSE' WHEN 'view' THEN 'OTHER' WHEN 'click' THEN 'None' ELSE 'EB' END AS data_category,
         n
  FROM faulty WHERE bad_keys = ''
), loaded AS (
  SELECT * FROM typed WHERE data_category IN ('EB', 'RESPONSE')
  QUALIFY row_number() OVER (PARTITION BY data_category, id ORDER BY n DESC) = 1
)
"""

_INGESTED = """
SELECT id, CAST(sid AS INTEGER) AS sid, service_name, TIMESTAMP '2024-02-01 00:00:00' AS record_time,
       CAST(total_count AS INTEGER) AS total_count, CAST(error_count AS INTEGER) AS error_count,
       error_rate, response_time_max, response_time_p95, CAST(98 AS DOUBLE) AS target_error_slo_perc, eb_health,
       burn_rate, eb_breached, CAST(project_id AS INTEGER) AS project_id, data_category
"""

def _whole_ingested() -> str:
    """All 83 columns: those that the items have, and the defaults of the others."""
    own = {
        "id": "id", "sid": "sid", "service_name": "service_name", "record_time": "TIMESTAMP '2024-02-01 00:00:00'", "total_count": "total_count",
        "error_count": "error_count", "error_rate": "error_rate", "response_time_max": "response_time_max", "response_time_p95": "response_time_p95",
        "eb_health": "eb_health", "burn_rate": "burn_rate", "eb_breached": "eb_breached", "project_id": "project_id", "data_category": "data_category",
    }
    columns = [f"CAST({own.get(f.column, 'NULL' if f.default is None else repr(f.default))} AS {_SQL_TYPES[f.dtype]}) AS {f.column}" for f in FIELDS]
    return ", ".join(columns)


# Pages take turns in nine forms; every ninth is left out.
_PAGES = f"""
WITH page AS (
  SELECT event_id // {PAGE_SIZE} AS page_id, count(*) AS items, count(*) FILTER (event_id % 31 <> 0) AS records FROM events GROUP BY 1
)
"""


# An alert is up from a window that reaches one threshold to the window that falls under the other.
_ALERTS = f"""
WITH placed AS (
  SELECT user_id % 10 AS k, date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS window_start, event_type
  FROM events, range(6) offsets(i)
), w AS (
  SELECT k, CAST(window_start AS TIMESTAMP) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS err
  FROM placed GROUP BY 1, 2
), b AS (
  SELECT *, 1e2 * err / n / (2e1 + 6 * (k % 5)) AS burn FROM w
), decided AS (
  SELECT *, CASE WHEN burn >= {RAISE_AT} THEN true WHEN burn < {CLEAR_AT} THEN false END AS decision FROM b
), stated AS (
  SELECT *, coalesce(last_value(decision IGNORE NULLS) OVER (PARTITION BY k ORDER BY window_start), false) AS raised FROM decided
), changed AS (
  SELECT *, coalesce(lag(raised) OVER (PARTITION BY k ORDER BY window_start), false) AS before FROM stated
)
"""

_BY_HOUR = f"""{HOURS}
SELECT service_name, hour(record_time) AS hour, {r("avg(error_rate)", "error_rate")},
       {lat("avg(response_time_avg)", "response_time_avg")}, {big("sum(total_count)", "total_count")}
FROM eb GROUP BY 1, 2"""


def oracle() -> dict[str, str]:
    composite = _composite()
    return {
        "current_sli": f"{PRELUDE}, sli AS ({_SLI}) {_SLI_SELECT}",
        "current_sli_one_service": f"{PRELUDE}, sli AS ({_SLI}) {_SLI_SELECT} WHERE service_name = '{SERVICE}'",
        "error_budget": f"{PRELUDE}{_window_sums('w', 168)} SELECT service_name, {_budget_select()} FROM w",
        "burn_rate": f"{PRELUDE}{_window_sums('w', 168)} SELECT service_name, {_burn_select()} FROM w",
        "slo_violations": f"""{PRELUDE}, sli AS ({_SLI})
SELECT service_name,
       concat_ws('|', CASE WHEN NOT {_ERROR_MET} THEN 'ERROR_RATE' END,
                      CASE WHEN NOT {_RESPONSE_MET} THEN 'RESPONSE_TIME' END) AS violation_codes,
       {big(f"CASE WHEN {_ERROR_MET} THEN 0 ELSE 1 END + CASE WHEN {_RESPONSE_MET} THEN 0 ELSE 1 END", "n_violations")},
       {r("avg_error_rate", "error_rate")}, {lat("avg_response_time", "response_time")},
       {volume("total_requests", "total_requests")}
FROM sli WHERE NOT ({_ERROR_MET} AND {_RESPONSE_MET})""",
        "service_summary": f"""{PRELUDE}, sli AS ({_SLI}){_window_sums("w", 168)}
SELECT sli.service_name, {r("avg_success_rate", "sli_success_rate")}, {r("avg_error_rate", "sli_error_rate")},
       {lat("avg_response_time", "sli_response_time_avg")}, {lat("p50", "sli_response_time_p50")},
       {lat("p95", "sli_response_time_p95")}, {lat("p99", "sli_response_time_p99")},
       {volume("total_requests", "sli_total_requests")}, {r("error_slo_target", "slo_targets_error_rate_target")},
       {lat("response_slo_target", "slo_targets_response_time_target")},
       {_ERROR_MET} AS slo_compliance_error_slo_met, {_RESPONSE_MET} AS slo_compliance_response_slo_met,
       {_ERROR_MET} AND {_RESPONSE_MET} AS slo_compliance_overall_slo_met,
       {_budget_select("error_budget_", "w.")}, CAST(NULL AS VARCHAR) AS error_budget_error,
       {_burn_select("burn_rate_", "w.")}, CAST(NULL AS VARCHAR) AS burn_rate_error
FROM sli JOIN w ON sli.service_name = w.service_name""",
        "degrading_services": _degrading(),
        "volume_trends": f"""{PRELUDE}, summary AS ({_VOLUME_SUMMARY})
SELECT p.service_name, CAST({WEEK_MINUTES} AS INTEGER) AS time_window_minutes, p.record_time AS timestamp,
       {big("p.total_count", "total_requests")}, {big("p.error_count", "errors")}, {r("p.error_rate", "error_rate")},
       {lat("p.response_time_avg", "response_time")}, s.total_volume AS summary_total_volume,
       s.total_errors AS summary_total_errors, s.avg_error_rate AS summary_avg_error_rate,
       s.avg_response_time AS summary_avg_response_time
FROM (SELECT * {_WEEK_ROWS}) p JOIN summary s ON p.service_name = s.service_name""",
        "volume_summary": f"{PRELUDE} {_VOLUME_SUMMARY}",
        "predict_issues": _risk(only_high=True),
        "service_risk": _risk(only_high=False),
        "historical_patterns": f"""{PRELUDE}
SELECT service_name, count(*) AS data_points, min(record_time) AS time_range_start, max(record_time) AS time_range_end,
       {_stats("error_rate_stats", "error_rate", "error_rate", "error_rate", r)},
       {_stats("response_time_stats", "response_time_avg", "response_time_min", "response_time_max", lat)},
       {big("sum(total_count)", "traffic_stats_total_requests")},
       {r("avg(total_count)", "traffic_stats_avg_requests_per_period")},
       {big("max(total_count)", "traffic_stats_peak_requests")}, {big("min(total_count)", "traffic_stats_min_requests")}
FROM eb GROUP BY service_name""",
        "hourly_patterns": f"""{PRELUDE}
SELECT service_name, hour(record_time) AS hour, {r("avg(error_rate)", "error_rate")},
       {lat("avg(response_time_avg)", "response_time_avg")}, {big("sum(total_count)", "total_count")}
FROM eb GROUP BY 1, 2""",
        "top_services_by_volume": f"""{PRELUDE}
SELECT service_name, {big("sum(total_count)", "total_requests")}, {r("avg(error_rate)", "avg_error_rate")},
       {lat("avg(response_time_avg)", "avg_response_time")}
FROM eb GROUP BY service_name ORDER BY sum(total_count) DESC, service_name LIMIT 5""",
        "service_health_overview": f"""{PRELUDE}, s AS (
  SELECT e.service_name, {_worst_columns(_FOUR_HEALTHS)}, sum(e.total_count) AS requests, sum(e.error_count) AS errors
  {_JOIN} GROUP BY e.service_name), t AS (
  SELECT count(*) AS n, count(*) FILTER (eb_health = 'HEALTHY') AS h, count(*) FILTER (eb_health = 'AT_RISK') AS a,
         count(*) FILTER (eb_health = 'UNHEALTHY') AS u, count(*) FILTER (response_health = 'HEALTHY') AS rh,
         count(*) FILTER (response_health <> 'HEALTHY') AS ru, sum(requests) AS requests, sum(errors) AS errors FROM s)
SELECT n AS total_services, h AS eb_healthy_services, a AS eb_at_risk_services, u AS eb_unhealthy_services,
       rh AS response_healthy_services, ru AS response_unhealthy_services, h AS healthy_services,
       a AS degraded_services, u AS violated_services, u AS unhealthy_services, {volume("requests", "total_requests")},
       {volume("errors", "total_errors")}, {r("1e2 * errors / requests", "overall_error_rate")},
       {r("1e2 * h / n", "health_percentage")}
FROM t""",
        "slowest_services": f"""{PRELUDE}, s AS (
  SELECT service_name, avg(response_time_avg) AS a, avg(response_time_p50) AS p50, avg(response_time_p95) AS p95,
         avg(response_time_p99) AS p99, max(response_time_max) AS mx, max(target_response_slo_sec) AS target,
         sum(total_count) AS requests
  FROM resp GROUP BY service_name ORDER BY coalesce(p99, a) DESC, service_name LIMIT 5)
SELECT service_name, {lat("a", "avg_response_time")}, {lat("p50", "response_time_p50")}, {lat("p95", "response_time_p95")},
       {lat("p99", "response_time_p99")}, {lat("mx", "max_response_time")}, {lat("target", "response_slo_target")},
       {big("requests", "total_requests")}, coalesce(p99, a) <= target AS slo_met
FROM s""",
        "error_prone_services": f"""{PRELUDE}, s AS (
  SELECT service_name, avg(error_rate) AS e, sum(error_count) AS errors, sum(total_count) AS requests,
         max(target_error_slo_perc) AS target
  FROM eb GROUP BY service_name HAVING avg(error_rate) > 0 ORDER BY e DESC, service_name LIMIT 5)
SELECT service_name, {r("e", "avg_error_rate")}, {big("errors", "total_errors")}, {big("requests", "total_requests")},
       {r("target", "error_slo_target")}, e <= target AS slo_met
FROM s""",
        "services_by_burn_rate": f"""{PRELUDE}
SELECT service_name, {r("avg(burn_rate)", "avg_burn_rate")}, {r("avg(eb_actual_consumed_percent)", "avg_eb_consumed")},
       {r("avg(eb_left_percent)", "avg_eb_left")}, {r("avg(error_rate)", "avg_error_rate")}, {worst("eb_health")} AS eb_health
FROM eb GROUP BY service_name HAVING avg(burn_rate) > 0 ORDER BY avg(burn_rate) DESC, service_name LIMIT 5""",
        "aspirational_slo_gap": f"""{PRELUDE}, s AS (
  SELECT e.service_name, {_worst_columns(_FOUR_HEALTHS)}, avg(e.eb_actual_consumed_percent) AS std,
         avg(e.aspirational_eb_actual_consumed_percent) AS asp, avg(e.burn_rate) AS burn
  {_JOIN} GROUP BY e.service_name)
SELECT service_name, {", ".join(name for name, _ in _FOUR_HEALTHS)}, {r("std", "std_eb_consumed")},
       {r("asp", "asp_eb_consumed")}, {r("burn", "avg_burn_rate")}
FROM s WHERE (eb_health = 'HEALTHY' AND aspirational_eb_health = 'UNHEALTHY')
          OR (response_health = 'HEALTHY' AND aspirational_response_health = 'UNHEALTHY')""",
        "timeliness_issues": f"""{PRELUDE}
SELECT service_name, timeliness_health, response_health, {r("avg(timeliness_consumed_percent)", "avg_timeliness_consumed")},
       {lat("avg(response_time_p95)", "avg_p95")}, {r("avg(error_rate)", "avg_error_rate")}
FROM eb WHERE timeliness_health = 'UNHEALTHY' GROUP BY service_name, timeliness_health, response_health""",
        "breach_vs_error": f"""{PRELUDE}, s AS (
  SELECT e.service_name, avg(r.response_error_rate) AS b, avg(e.error_rate) AS x, avg(r.response_breach_count) AS bc,
         avg(e.error_count) AS xc, avg(r.response_time_p95) AS p95
  {_JOIN} GROUP BY e.service_name)
SELECT service_name, {r("coalesce(b, 0)", "avg_breach_rate")}, {r("coalesce(x, 0)", "avg_error_rate")},
       {big("trunc(coalesce(bc, 0))", "avg_breach_count")}, {big("trunc(coalesce(xc, 0))", "avg_error_count")},
       {lat("coalesce(p95, 0)", "avg_p95")},
       CASE WHEN b > x THEN 'LATENCY_ISSUE' WHEN x > b THEN 'RELIABILITY_ISSUE' ELSE 'BALANCED' END AS issue_type
FROM s""",
        "budget_exhausted": f"""{PRELUDE}
SELECT service_name, {r("eb_actual_consumed_percent", "eb_actual_consumed_percent")}, {big("eb_left_count", "eb_left_count")},
       {r("aspirational_eb_actual_consumed_percent", "aspirational_eb_actual_consumed_percent")},
       {r("burn_rate", "burn_rate")}, eb_health, {r("avg(error_rate)", "avg_error_rate")}
FROM eb WHERE eb_actual_consumed_percent >= 100 OR eb_left_count < 0
GROUP BY service_name, eb.eb_actual_consumed_percent, eb.eb_left_count, eb.aspirational_eb_actual_consumed_percent,
         eb.burn_rate, eb_health""",
        "composite_health": composite,
        "composite_health_json": composite,
        "composite_health_text": f"SELECT CAST(to_json(s) AS VARCHAR) AS value FROM ({composite}) s",
        "severity_heatmap": f"""{PRELUDE}
SELECT e.service_name, {big(_colours("#FD346E"), "red_count")}, {big(_colours("#07AE86"), "green_count")},
       r.response_severity, e.eb_severity, e.timeliness_severity, {r("avg(e.burn_rate)", "avg_burn_rate")}
{_JOIN}
GROUP BY e.service_name, r.response_severity, e.eb_severity, e.timeliness_severity, r.aspirational_response_severity,
         e.aspirational_eb_severity""",
        "governance_status": f"""{PRELUDE}, s AS (
  SELECT service_name, avg(burn_rate) AS burn, {worst("eb_health")} AS eb_health, {worst("response_health")} AS response_health,
         max(CAST(eb_breached AS INTEGER)) > 0 AS eb_breached, avg(eb_left_percent) AS eb_left
  FROM eb GROUP BY service_name)
SELECT service_name, CASE WHEN eb_health = 'UNHEALTHY' AND burn > 5 THEN 'CRITICAL' WHEN eb_health = 'UNHEALTHY' THEN 'NEEDS_REVIEW'
            WHEN eb_health = 'AT_RISK' THEN 'AT_RISK' ELSE 'HEALTHY' END AS governance_status,
       {r("burn", "avg_burn_rate")}, eb_health, response_health, eb_breached, {r("eb_left", "eb_left_percent")}
FROM s WHERE eb_health IN ('UNHEALTHY', 'AT_RISK')""",
        "services_by_slo_status": f"{PRELUDE} SELECT eb_slo_status, count(*) AS records FROM eb GROUP BY eb_slo_status",
        "adhoc_sql": f"""{PRELUDE}
SELECT service_name, count(*) AS days, {r("avg(error_rate)", "avg_error_rate")}
FROM eb WHERE error_rate > 20 AND service_name IN (SELECT service_name FROM resp) GROUP BY service_name""",
        "service_logs": f"{PRELUDE} SELECT {_plain_logs()} FROM eb",
        "service_logs_of_one": f"""{PRELUDE}, w AS (
  SELECT eb.* FROM eb, (SELECT max(record_time) AS latest FROM eb) m
  WHERE service_name = '{SERVICE}' AND record_time BETWEEN latest - INTERVAL {WEEK_MINUTES} MINUTE AND latest
  ORDER BY record_time DESC, id DESC LIMIT 5)
SELECT {_plain_logs()} FROM w""",
        "all_services": f"{PRELUDE} SELECT DISTINCT service_name FROM eb",
        "time_range": f"{PRELUDE} SELECT min(record_time) AS min_time, max(record_time) AS max_time FROM eb",
        "daily_rollup": f"{PRELUDE} SELECT {_plain_logs()} FROM eb UNION ALL SELECT {_plain_logs()} FROM resp",
        "window_burn_rate": f"""
WITH placed AS (
  SELECT user_id % 10 AS k, date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS window_start, event_type
  FROM events, range(6) offsets(i)
), w AS (
  SELECT k, CAST(window_start AS TIMESTAMP) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS err
  FROM placed GROUP BY 1, 2
), b AS (SELECT *, 1e2 * err / n AS actual, 2e1 + 6 * (k % 5) AS target FROM w)
SELECT 'svc_' || k AS service_name, window_start, window_start + INTERVAL 6 HOUR AS window_end, n AS total_requests,
       err AS total_errors, {r("actual", "actual_error_rate")}, {r("target", "error_slo_target")},
       {r("actual / target", "burn_rate")},
       CASE WHEN actual / target < 1 THEN 'healthy' WHEN actual / target < 2 THEN 'warning'
            WHEN actual / target < 10 THEN 'critical' ELSE 'emergency' END AS severity
FROM b""",
        "window_burn_rate_uneven": f"""
WITH placed AS (
  SELECT user_id % 10 AS k, date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS window_start, ts, event_type
  FROM events, range(2) offsets(i)
), w AS (
  SELECT k, CAST(window_start AS TIMESTAMP) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS err
  FROM placed WHERE ts < window_start + INTERVAL 90 MINUTE GROUP BY 1, 2
), b AS (SELECT *, 1e2 * err / n AS actual, 2e1 + 6 * (k % 5) AS target FROM w)
SELECT 'svc_' || k AS service_name, window_start, window_start + INTERVAL 90 MINUTE AS window_end, n AS total_requests,
       err AS total_errors, {r("actual", "actual_error_rate")}, {r("target", "error_slo_target")},
       {r("actual / target", "burn_rate")},
       CASE WHEN actual / target < 1 THEN 'healthy' WHEN actual / target < 2 THEN 'warning'
            WHEN actual / target < 10 THEN 'critical' ELSE 'emergency' END AS severity
FROM b""",
        "ingested_records": f"{_INGEST} {_INGESTED} FROM loaded",
        "ingested_cut_pages": f"{_INGEST} {_INGESTED} FROM loaded",
        "ingested_whole_records": f"{_INGEST} SELECT {_whole_ingested()} FROM loaded",
        "ingest_rejects": f"{_INGEST} SELECT page_id, pos, bad_keys FROM faulty WHERE bad_keys <> ''",
        "page_problems": f"""{_PAGES}
SELECT page_id, CASE page_id % 9 WHEN 4 THEN 'unreadable' WHEN 7 THEN 'missing' ELSE 'short' END AS reason
FROM page WHERE (page_id % 9 = 4 OR page_id % 9 IN (2, 3, 7) AND page_id < (SELECT max(page_id) FROM page WHERE page_id % 9 <> 7))""",
        "page_counts": f"""{_PAGES}
SELECT page_id,
       CAST(CASE page_id % 9 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE records END AS BIGINT) AS records,
       CAST(CASE page_id % 9 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE items END AS BIGINT) AS items
FROM page WHERE page_id % 9 <> 7""",
        "ingest_statistics": f"""{_INGEST}
SELECT count(*) FILTER (data_category = 'EB') AS eb_records, count(*) FILTER (data_category = 'RESPONSE') AS response_records,
       count(*) FILTER (data_category = 'EB' AND eb_health = 'UNHEALTHY') AS unhealthy_records,
       count(*) FILTER (data_category = 'EB' AND eb_health = 'UNHEALTHY') AS eb_unhealthy_records,
       count(*) FILTER (data_category = 'EB' AND burn_rate > 2) AS high_burn_records
FROM loaded""",
        "run_problems": f"""
WITH page AS (
  SELECT DISTINCT event_id // {PAGE_SIZE} // {RUN_PAGES} AS run, event_id // {PAGE_SIZE} % {RUN_PAGES} AS page_id FROM events
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY run) AS last FROM page WHERE page_id % 7 <> 3
)
SELECT 'run_' || run AS sequence, page_id, 'missing' AS reason
FROM (SELECT DISTINCT run, last, unnest(range(0, last)) AS page_id FROM kept) WHERE page_id % 7 = 3""",
        "run_records": f"""{_INGEST}, placed AS (
  SELECT * REPLACE (CASE WHEN n % 11 <> 0 THEN id WHEN n % 3 <> 0 THEN 'platform_' || n
                         ELSE 'platform_run_' || (n // {PAGE_SIZE} // {RUN_PAGES}) || ':' || (n // {PAGE_SIZE} % {RUN_PAGES}) || ':' || (n % {PAGE_SIZE}) END AS id)
  FROM typed WHERE data_category IN ('EB', 'RESPONSE') AND n // {PAGE_SIZE} % {RUN_PAGES} % 7 <> 3
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY data_category, id ORDER BY 'run_' || (n // {PAGE_SIZE} // {RUN_PAGES}) DESC, n DESC) AS i FROM placed
)
SELECT id, CAST(sid AS INTEGER) AS sid, data_category, error_rate FROM ranked WHERE i = 1""",
        # Where two batches have an id, the row of the later batch stays, and within one the row that arrived last.
        "latest_records": f"""{_INGEST}, sized AS (
  SELECT event_id // {PAGE_SIZE} AS page_id, count(*) AS items FROM events GROUP BY 1
), offsets AS (
  SELECT page_id, sum(items) OVER (PARTITION BY page_id % 3 ORDER BY page_id) - items AS page_offset FROM sized
), renamed AS (
  SELECT typed.* REPLACE (CASE WHEN typed.n % 11 = 0 AND typed.n % 3 = 0 THEN 'platform_' || CAST(page_offset + typed.n % {PAGE_SIZE} AS BIGINT) ELSE id END AS id)
  FROM typed JOIN offsets ON typed.n // {PAGE_SIZE} = page_id WHERE data_category IN ('EB', 'RESPONSE')
), newest AS (
  SELECT * FROM renamed QUALIFY row_number() OVER (PARTITION BY data_category, id ORDER BY (n // {PAGE_SIZE}) % 3 DESC, n DESC) = 1
)
SELECT * EXCLUDE (record_time) FROM ({_INGESTED} FROM newest)""",
        "replaced_snapshot": f"""{_INGEST}, sized AS (
  SELECT event_id // {PAGE_SIZE} AS page_id, count(*) AS items FROM events GROUP BY 1
), offsets AS (
  SELECT page_id, sum(items) OVER (PARTITION BY page_id % 3 ORDER BY page_id) - items AS page_offset FROM sized
), renamed AS (
  SELECT typed.* REPLACE (CASE WHEN typed.n % 11 = 0 AND typed.n % 3 = 0 THEN 'platform_' || CAST(page_offset + typed.n % {PAGE_SIZE} AS BIGINT) ELSE id END AS id), page_id
  FROM typed JOIN offsets ON typed.n // {PAGE_SIZE} = page_id
  WHERE data_category = 'EB' AND page_id % 3 = 1 OR data_category = 'RESPONSE' AND page_id % 3 = 0
), newest AS (
  SELECT * FROM renamed QUALIFY row_number() OVER (PARTITION BY data_category, id ORDER BY n DESC) = 1
)
SELECT id, data_category, CAST(total_count AS INTEGER) AS total_count, error_rate, eb_health FROM newest""",
        "coerced_times": """
WITH forms AS (
  SELECT event_id AS n, 'i' || (event_id % 5000) AS id, CAST(event_id % 100 AS INTEGER) AS total_count, event_id % 3 AS form,
         CASE WHEN event_id % 3 < 2 THEN make_timestamp(1700000000000000 + event_id * 1000000)
              WHEN event_id % 7 > 1 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS record_time
  FROM events WHERE event_id % 10 <> 3
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form, id ORDER BY n DESC) AS i FROM forms WHERE record_time IS NOT NULL
)
SELECT id, record_time, total_count FROM ranked WHERE i = 1""",
        "burn_alerts": f"""{_ALERTS}, islands AS (
  SELECT *, sum(CASE WHEN raised AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY window_start) AS alert,
         lead(window_start) OVER (PARTITION BY k ORDER BY window_start) AS next_start
  FROM changed
)
SELECT 'svc_' || k AS service_name, min(window_start) AS raised_at, CASE WHEN bool_and(next_start IS NOT NULL) THEN max(next_start) END AS cleared_at, count(*) AS windows,
       {r("max(burn)", "peak_burn_rate")}, arg_max(window_start, (burn, -epoch(window_start))) AS peak_at,
       CASE WHEN max(burn) < 1 THEN 'healthy' WHEN max(burn) < 2 THEN 'warning' WHEN max(burn) < 10 THEN 'critical' ELSE 'emergency' END AS severity
FROM islands WHERE raised GROUP BY k, alert""",
        "alert_changes": f"""{_ALERTS}
SELECT 'svc_' || k AS service_name, window_start, CASE WHEN raised THEN 'raised' ELSE 'cleared' END AS change, {r("burn", "burn_rate")}
FROM changed WHERE raised <> before""",
        "hours_of_day": _BY_HOUR,
        "hours_of_day_from_partials": _BY_HOUR,
        "risk_from_partials": _risk(only_high=False, prelude=HOURS),
        "history_from_partials": f"""{HOURS}
SELECT service_name, count(*) AS data_points, min(record_time) AS time_range_start, max(record_time) AS time_range_end,
       {_moments("error_rate_stats", "error_rate", "error_rate", "error_rate", r)},
       {_moments("response_time_stats", "response_time_avg", "response_time_min", "response_time_max", lat)},
       {big("sum(total_count)", "traffic_stats_total_requests")},
       {r("avg(total_count)", "traffic_stats_avg_requests_per_period")},
       {big("max(total_count)", "traffic_stats_peak_requests")}, {big("min(total_count)", "traffic_stats_min_requests")},
       {", ".join(f"true AS {stats}_stats_p{p}_near" for stats in ("error_rate", "response_time") for p in (50, 95, 99))}
FROM eb GROUP BY service_name""",
        "answers_for_asked": f"""{PRELUDE}{_window_sums('w', 168)}, found AS (SELECT service_name, {_budget_select()} FROM w)
SELECT a.service_name, found.* EXCLUDE (service_name, time_window_hours),
       CASE WHEN found.service_name IS NULL THEN 'No data found for this service' END AS error
FROM (VALUES ('svc_3'), ('svc_99'), ('svc_7')) a(service_name) LEFT JOIN found USING (service_name)""",
    }
