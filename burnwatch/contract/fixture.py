"""Rules that turn the ``events`` test table into service logs."""

from __future__ import annotations

from burnwatch.sources.rollup import EventRules

_K = "CAST(substr(_service, 5) AS BIGINT)"

EVENT_RULES = EventRules(
    service="concat('svc_', CAST(user_id % 10 AS STRING))",
    unit=100.0,
    slow="value > 100",
    late="hour(ts) >= 18",
    error_target=f"20D + 6 * CAST({_K} % 5 AS DOUBLE)",
    response_target=f"14D + 6 * CAST({_K} % 4 AS DOUBLE)",
    response_seconds=f"0.46D + 0.02D * ({_K} % 5)",
    timeliness_target=f"30D + 20 * CAST({_K} % 3 AS DOUBLE)",
    status=f"CASE WHEN {_K} % 2 = 0 THEN 'APPROVED' ELSE 'UNDER_REVIEW' END",
    timed="_service <> 'svc_9'",
)
