"""Edge rows with expected values worked out by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from burnwatch import SloTables
from burnwatch.operators import budget, degradation, health, rankings, sli, trends
from burnwatch.plans.tables import all_services, run_sql, service_logs, time_range
from burnwatch.schema import GREEN, RED

DAY = datetime(2024, 1, 10)


def by_service(frame):
    return {row.service_name: row for row in frame.collect()}


def test_service_without_response_rows(tables):
    t = tables([{"total_count": 10, "error_count": 1, "error_rate": 1.0}], [{"service_name": "other"}])
    row = by_service(sli.current_sli(t))["a"]
    assert (row.error_slo_met, row.response_slo_met, row.overall_slo_met) == (True, False, False)
    assert (row.total_requests, row.total_errors, row.avg_response_time) == (10, 1, None)
    violation = by_service(sli.slo_violations(t))["a"]
    assert violation.violation_codes == ["RESPONSE_TIME"]
    assert violation.violations == ["Response time nans exceeds target 1.000s"]
    assert health.service_health_overview(t).first().response_healthy_services == 1


def test_sums_show_the_row_product(tables):
    t = tables(
        [{"total_count": 10, "error_count": 1, "error_rate": 10.0}, {"total_count": 20, "error_count": 1, "error_rate": 20.0}],
        [{"response_time_avg": x} for x in (1.0, 2.0, 6.0)],
    )
    row = by_service(sli.current_sli(t))["a"]
    assert (row.total_requests, row.total_errors, row.avg_error_rate, row.avg_response_time) == (90, 6, 15.0, 3.0)
    assert by_service(sli.current_sli(t, dedupe_volume=True))["a"].total_requests == 30
    assert health.service_health_overview(t).first().total_requests == 90


def test_null_service_name_matches_nothing(tables):
    t = tables([{"service_name": None, "total_count": 5}], [{"service_name": None}, {"service_name": None}])
    (row,) = sli.current_sli(t).collect()
    assert (row.service_name, row.total_requests, row.response_slo_met) == (None, 5, False)


@pytest.mark.parametrize("value", [None, "None", "unhealthy", "HEALTHY"])
def test_unknown_health_counts_as_healthy(tables, value):
    t = tables([{"eb_health": value}])
    assert health.composite_health_score(t).first().eb_health == "HEALTHY"


def test_worst_health_wins(tables):
    t = tables([{"eb_health": h} for h in ("HEALTHY", "UNHEALTHY", "AT_RISK")], [{"response_health": "AT_RISK"}])
    row = health.composite_health_score(t).first()
    assert (row.eb_health, row.response_health, row.healthy_dimensions, row.health_score) == ("UNHEALTHY", "AT_RISK", 3, 60.0)


def test_composite_order(tables):
    t = tables(
        [
            {"service_name": "b", "eb_health": "UNHEALTHY", "burn_rate": 1.0},
            {"service_name": "c", "eb_health": "UNHEALTHY", "burn_rate": 3.0},
            {"service_name": "d", "burn_rate": 9.0},
            {"service_name": "a", "eb_health": "UNHEALTHY", "burn_rate": 1.0},
        ]
    )
    assert [r.service_name for r in health.composite_health_score(t).collect()] == ["c", "a", "b", "d"]


def test_gap_needs_a_healthy_standard(tables):
    t = tables(
        [
            {"service_name": "gap", "aspirational_eb_health": "UNHEALTHY"},
            {"service_name": "bad", "eb_health": "UNHEALTHY", "aspirational_eb_health": "UNHEALTHY"},
            {"service_name": "slow"},
        ],
        [{"service_name": "slow", "aspirational_response_health": "UNHEALTHY"}],
    )
    assert set(by_service(health.aspirational_slo_gap(t))) == {"gap", "slow"}


def test_breach_without_response_rows_is_balanced_and_last(tables):
    t = tables(
        [
            {"service_name": "a", "error_rate": 5.0, "error_count": 3},
            {"service_name": "a", "error_rate": 5.0, "error_count": 4},
            {"service_name": "b", "error_rate": 5.0},
            {"service_name": "c", "error_rate": 1.0},
        ],
        [{"service_name": "b", "response_error_rate": 1.0}, {"service_name": "c", "response_error_rate": 2.0}],
    )
    rows = budget.breach_vs_error_analysis(t).collect()
    assert [(r.service_name, r.issue_type) for r in rows] == [
        ("c", "LATENCY_ISSUE"),
        ("b", "RELIABILITY_ISSUE"),
        ("a", "BALANCED"),
    ]
    assert (rows[2].avg_breach_rate, rows[2].avg_error_count) == (0.0, 3)
    assert [r.service_name for r in budget.breach_vs_error_analysis(t, "b").collect()] == ["b"]


def window_rows(service, baseline, recent, **extra):
    return [
        {"service_name": service, "record_time": DAY - timedelta(minutes=40), "error_rate": baseline} | extra,
        {"service_name": service, "record_time": DAY, "error_rate": recent} | extra,
    ]


def test_degradation(tables):
    t = tables(
        window_rows("zero_up", 0.0, 5.0)
        + window_rows("zero", 0.0, 0.0)
        + window_rows("double", 10.0, 21.0)
        + window_rows("half", 10.0, 16.0)
        + window_rows("calm", 10.0, 11.0)
        + window_rows("unknown", None, 3.0)
        + [{"service_name": "new", "record_time": DAY, "error_rate": 50.0}]
    )
    rows = degradation.degrading_services(t).collect()
    assert [(r.service_name, r.severity) for r in rows] == [("double", "critical"), ("zero_up", "warning"), ("half", "warning")]
    assert [round(r.error_rate_change_percent, 9) for r in rows] == [110.0, 100.0, 60.0]


def test_degradation_window_edges(tables):
    edge = DAY - timedelta(minutes=30)
    rows = [
        {"record_time": DAY - timedelta(minutes=60), "error_rate": 1.0},
        {"record_time": edge, "error_rate": 4.0, "total_count": 7},
        {"record_time": DAY, "error_rate": 2.0, "total_count": 5},
        {"record_time": DAY - timedelta(minutes=61), "error_rate": 99.0},
    ]
    row = degradation.degrading_services(tables(rows)).first()
    assert (row.error_rate_baseline, row.error_rate_recent, row.total_requests_recent) == (1.0, 3.0, 12)


def test_missing_percentile_is_no_change_and_missing_error_rate_is_minor(tables):
    base = {"record_time": DAY - timedelta(minutes=40), "error_rate": None, "response_time_p99": None}
    now = {"record_time": DAY, "error_rate": None, "response_time_p99": 9.0}
    t = tables([base | {"response_time_p95": 1.0}, now | {"response_time_p95": 9.0}])
    row = degradation.degrading_services(t).first()
    assert (row.response_time_p99_change_percent, row.response_time_p95_change_percent) == (0.0, 800.0)
    assert (row.error_rate_change_percent, row.severity) == (None, "minor")


def test_volume_trends(tables):
    t = tables(
        [
            {"record_time": DAY - timedelta(minutes=31), "total_count": 100},
            {"record_time": DAY, "total_count": 5, "error_rate": 4.0},
            {"record_time": DAY - timedelta(minutes=30), "total_count": None, "error_rate": None},
            {"service_name": "b", "record_time": DAY, "total_count": 1},
        ]
    )
    rows = degradation.volume_trends(t, "a").collect()
    assert [(r.timestamp, r.total_requests, r.error_rate) for r in rows] == [
        (DAY - timedelta(minutes=30), 0, 0.0),
        (DAY, 5, 4.0),
    ]
    assert {(r.summary.total_volume, r.summary.avg_error_rate) for r in rows} == {(5, 4.0)}
    assert degradation.volume_trends(t).count() == 3


def history(n, **last):
    rows = [{"record_time": DAY + timedelta(days=i), "error_rate": 1.0, "response_time_avg": 0.1} for i in range(n)]
    rows[-1] |= last
    return rows


def test_risk_needs_three_rows(tables):
    assert trends.service_risk(tables(history(2, error_rate=500.0))).count() == 0
    assert trends.service_risk(tables(history(3, error_rate=500.0))).count() == 1


@pytest.mark.parametrize(
    ("last", "score", "level"),
    [
        # 25 + 20: close to the response target, and a rising response time.
        ({"response_time_avg": 0.8}, 45, "medium"),
        # 30: only a rising error rate.
        ({"error_rate": 2.0}, 30, "medium"),
        # 20 + 25 + 40: over the response target.
        ({"response_time_avg": 1.5}, 85, "critical"),
        # 30 + 15 + 25: rising, volatile, close to the error target.
        ({"error_rate": 70.0}, 70, "critical"),
        # 30 + 20: both rise.
        ({"error_rate": 2.0, "response_time_avg": 0.2}, 50, "high"),
    ],
)
def test_risk_levels(tables, last, score, level):
    rows = [row | {"target_error_slo_perc": 98.0} for row in history(5, **last)]
    (row,) = trends.service_risk(tables(rows)).collect()
    assert (row.risk_score, row.risk_level) == (score, level)
    assert trends.predict_issues_today(tables(rows)).count() == (score >= 50)


def test_risk_sentences_and_calm_service(tables):
    (row,) = trends.service_risk(tables(history(3, response_time_avg=1.5))).collect()
    assert row.risk_factors == [
        "Response time trending upward (slope: 0.700)",
        "Response time at 1.500s (target: 1.000s)",
        "Currently violating response time SLO",
    ]
    assert trends.service_risk(tables(history(4))).count() == 0


def test_patterns_of_one_row(tables):
    row = trends.historical_patterns(
        tables([{"error_rate": 3.0, "record_time": datetime(2024, 1, 1, 5), "total_count": 4}])
    ).first()
    stats = row.error_rate_stats
    assert (stats.mean, stats.std, stats.min, stats.max, stats.p50, stats.p95, stats.p99) == (3.0, None, 3.0, 3.0, 3.0, 3.0, 3.0)
    assert row.hourly_patterns[5].total_count == 4
    assert (row.data_points, row.traffic_stats.peak_requests) == (1, 4)


def test_error_budget(tables):
    t = tables(
        [
            {"service_name": "ok", "record_time": DAY, "total_count": 100, "error_count": 5, "target_error_slo_perc": 10.0},
            {"service_name": "ok", "record_time": DAY - timedelta(hours=4), "total_count": 100, "error_count": 5, "target_error_slo_perc": 50.0},
            {"service_name": "old", "record_time": DAY - timedelta(hours=5), "total_count": 100},
            {"service_name": "free", "record_time": DAY, "total_count": 100, "error_count": 5, "target_error_slo_perc": 0.0},
            {"service_name": "idle", "record_time": DAY, "total_count": 0},
        ]
    )
    rows = by_service(sli.error_budget(t, as_of=DAY))
    assert set(rows) == {"ok", "free", "idle"}
    ok = rows["ok"]
    assert (ok.total_requests, ok.error_slo_target_percent, ok.error_budget, ok.budget_remaining) == (200, 10.0, 20.0, 10.0)
    assert (ok.budget_consumed_percent, ok.status) == (50.0, "healthy")
    assert (rows["free"].budget_consumed_percent, rows["free"].status) == (0.0, "budget_exceeded")
    assert (rows["idle"].budget_remaining, rows["idle"].status) == (0.0, "budget_exceeded")
    success = by_service(sli.error_budget(t, "ok", as_of=DAY, target_is_success=True))["ok"]
    assert success.error_budget == pytest.approx(180.0)


@pytest.mark.parametrize(("errors", "severity"), [(9, "healthy"), (10, "warning"), (20, "critical"), (100, "emergency")])
def test_burn_severity(tables, errors, severity):
    t = tables([{"record_time": DAY, "total_count": 100, "error_count": errors, "target_error_slo_perc": 10.0}])
    row = sli.burn_rate(t, as_of=DAY).first()
    assert (row.burn_rate, row.severity) == (pytest.approx(errors / 10), severity)


def test_burn_of_idle_service_and_zero_target(tables):
    t = tables(
        [
            {"service_name": "idle", "record_time": DAY, "total_count": 0},
            {"service_name": "free", "record_time": DAY, "total_count": 10, "error_count": 5, "target_error_slo_perc": 0.0},
        ]
    )
    rows = by_service(sli.burn_rate(t, as_of=DAY))
    assert (rows["idle"].burn_rate, rows["free"].burn_rate) == (0.0, 0.0)


def test_default_window_ends_now(tables):
    t = tables([{"record_time": datetime.now() - timedelta(minutes=5), "total_count": 3}, {"record_time": DAY, "total_count": 9}])
    assert sli.error_budget(t).first().total_requests == 3


def test_service_summary(tables):
    t = tables(
        [
            {"record_time": DAY, "total_count": 10, "error_count": 1, "error_rate": 10.0, "target_error_slo_perc": 20.0},
            {"service_name": "b", "record_time": DAY - timedelta(hours=2), "total_count": 10},
        ],
        [{"response_time_avg": 0.5}],
    )
    rows = by_service(sli.service_summary(t, as_of=DAY))
    a, b = rows["a"], rows["b"]
    assert (a.sli.error_rate, a.slo_compliance.overall_slo_met, a.error_budget.error_budget) == (10.0, True, 2.0)
    assert (a.burn_rate.burn_rate, a.burn_rate.error) == (0.5, None)
    assert (b.error_budget.total_requests, b.burn_rate.burn_rate, b.burn_rate.error) == (10, None, sli.NO_DATA)
    assert sli.service_summary(t, "nobody", as_of=DAY).count() == 0


def test_slowest_falls_back_to_average(tables):
    t = tables(
        [{}],
        [
            {"service_name": "p", "response_time_p99": 2.0, "response_time_avg": 0.1, "target_response_slo_sec": 3.0},
            {"service_name": "avg", "response_time_p99": None, "response_time_avg": 5.0, "target_response_slo_sec": 1.0},
            {"service_name": "free", "response_time_p99": 1.0, "target_response_slo_sec": None},
            {"service_name": "none", "response_time_p99": None, "response_time_avg": None},
        ],
    )
    rows = rankings.slowest_services(t).collect()
    assert [(r.service_name, r.slo_met) for r in rows] == [("avg", False), ("p", True), ("free", True), ("none", True)]
    assert rows[2].response_slo_target == 1.0


def test_rankings_leave_out_zero_and_break_ties_by_name(tables):
    t = tables([{"service_name": s, "error_rate": e, "burn_rate": e, "total_count": 5} for s, e in (("b", 1.0), ("a", 1.0), ("c", 0.0))])
    assert [r.service_name for r in rankings.error_prone_services(t).collect()] == ["a", "b"]
    assert [r.service_name for r in rankings.services_by_burn_rate(t).collect()] == ["a", "b"]
    assert [r.service_name for r in rankings.top_services_by_volume(t, 2).collect()] == ["a", "b"]


def test_budget_exhausted(tables):
    t = tables(
        [
            {"service_name": "negative", "eb_actual_consumed_percent": 99.99, "eb_left_count": -1},
            {"service_name": "unknown_left", "eb_actual_consumed_percent": 100.0, "eb_left_count": None},
            {"service_name": "fine", "eb_actual_consumed_percent": 99.99, "eb_left_count": 0},
            {"service_name": "nothing", "eb_actual_consumed_percent": None, "eb_left_count": None},
        ]
    )
    rows = budget.budget_exhausted_services(t).collect()
    assert [(r.service_name, r.eb_left_count) for r in rows] == [("unknown_left", 0), ("negative", -1)]


def test_heatmap_keeps_rows_that_differ_in_hidden_colours(tables):
    t = tables(
        [{"aspirational_eb_severity": RED, "burn_rate": 1.0}, {"aspirational_eb_severity": GREEN, "burn_rate": 2.0}],
        [{"response_severity": RED}, {"response_severity": RED}],
    )
    rows = health.severity_heatmap(t).collect()
    assert [(r.red_count, r.green_count, r.avg_burn_rate) for r in rows] == [(2, 3, 1.0), (1, 4, 2.0)]
    alone = health.severity_heatmap(tables([{}])).first()
    assert (alone.red_count, alone.green_count, alone.response_severity) == (0, 3, None)


def test_governance_limit_is_exclusive(tables):
    t = tables(
        [
            {"service_name": "at", "eb_health": "UNHEALTHY", "burn_rate": 5.0, "eb_breached": None},
            {"service_name": "over", "eb_health": "UNHEALTHY", "burn_rate": 5.5, "eb_breached": True},
            {"service_name": "risk", "eb_health": "AT_RISK", "burn_rate": 9.0},
            {"service_name": "fine"},
        ]
    )
    rows = health.slo_governance_status(t).collect()
    assert [(r.service_name, r.governance_status, r.eb_breached) for r in rows] == [
        ("risk", "AT_RISK", False),
        ("over", "CRITICAL", True),
        ("at", "NEEDS_REVIEW", False),
    ]


def test_timeliness_keeps_missing_group_keys(tables):
    t = tables([{"timeliness_health": "UNHEALTHY", "response_health": None, "response_time_p95": None}, {}])
    (row,) = health.timeliness_issues(t).collect()
    assert (row.response_health, row.avg_p95) == (None, 0.0)


def test_quotes_in_names(tables):
    name = "o'brien"
    t = tables([{"service_name": name, "total_count": 2}, {"service_name": "x"}])
    assert [r.service_name for r in sli.current_sli(t, name).collect()] == [name]
    assert service_logs(t, name).count() == 1
    found = run_sql(t, "SELECT count(*) AS n FROM service_logs_eb WHERE service_name = :s", {"s": name})
    assert found.first().n == 1


def test_service_logs(tables):
    t = tables([{"record_time": DAY + timedelta(days=i), "total_count": i} for i in range(4)])
    rows = service_logs(t, "", DAY + timedelta(days=1), DAY + timedelta(days=3), limit=2).collect()
    assert [r.total_count for r in rows] == [3, 2]
    assert service_logs(t, limit=0).count() == 4
    assert [r.service_name for r in all_services(t).collect()] == ["a"]
    assert tuple(time_range(t).first()) == (DAY, DAY + timedelta(days=3))


def test_empty_tables(tables):
    t = tables([])
    for operator in (
        sli.current_sli,
        sli.slo_violations,
        sli.error_budget,
        sli.burn_rate,
        sli.service_summary,
        degradation.degrading_services,
        degradation.volume_trends,
        trends.predict_issues_today,
        trends.historical_patterns,
        rankings.top_services_by_volume,
        rankings.slowest_services,
        rankings.error_prone_services,
        rankings.services_by_burn_rate,
        health.aspirational_slo_gap,
        health.timeliness_issues,
        budget.breach_vs_error_analysis,
        budget.budget_exhausted_services,
        health.composite_health_score,
        health.severity_heatmap,
        health.slo_governance_status,
        all_services,
    ):
        assert operator(t).count() == 0, operator.__name__
    overview = health.service_health_overview(t).collect()
    assert [set(row.asDict().values()) for row in overview] == [{0}]


def test_invariants(tables):
    names = "abcdefgh"
    health_of = ["HEALTHY", "AT_RISK", "UNHEALTHY"]
    t = tables(
        [
            {"service_name": s, "eb_health": health_of[i % 3], "aspirational_eb_health": health_of[(i + 1) % 3], "error_rate": 20.0 * i}
            for i, s in enumerate(names)
        ],
        [{"service_name": s, "response_health": health_of[i % 2], "response_time_avg": 0.3 * i} for i, s in enumerate(names)],
    )
    o = health.service_health_overview(t).first()
    assert o.eb_healthy_services + o.eb_at_risk_services + o.eb_unhealthy_services == o.total_services == 8
    assert o.response_healthy_services + o.response_unhealthy_services == 8
    for r in health.composite_health_score(t).collect():
        dims = (r.eb_health, r.response_health, r.timeliness_health, r.aspirational_eb_health, r.aspirational_response_health)
        assert r.healthy_dimensions == dims.count("HEALTHY")
    missed = {r.service_name for r in sli.current_sli(t).collect() if not r.overall_slo_met}
    assert {r.service_name for r in sli.slo_violations(t).collect()} == missed


def test_row_products_beyond_64_bits(tables):
    """Two sides of 50,000 rows whose product of volumes and rows passes 2^63."""
    from pyspark.sql import functions as F

    t = tables([{"service_name": "a"}], [{"service_name": "a"}])
    many = t.logs.withColumn("total_count", F.lit(2_000_000_000)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("_i")
    (row,) = health.service_health_overview(SloTables.from_logs(many)).collect()
    assert row.total_requests == 2e9 * 100_000 * 100_000
