from __future__ import annotations

import json

import pytest

from burnwatch.registry import FUNCTIONS, json_rows, run


def test_functions(tables):
    t = tables([{"total_count": 4, "error_rate": 2.0}], [{"response_time_avg": 0.5}])
    assert len(FUNCTIONS) == 20
    for name in FUNCTIONS:
        assert run(name, t).columns
    assert run("get_top_services_by_volume", t, limit=1).first().total_requests == 4
    assert run("calculate_error_budget", t, service_name="a", time_window_hours=1).count() == 0


def test_unknown_function(tables):
    with pytest.raises(KeyError, match="get_current_sli"):
        run("nothing", tables([]))


def test_json_rows(spark):
    frame = spark.sql(
        "SELECT 'a' AS s, CAST('NaN' AS DOUBLE) AS d, CAST(NULL AS INT) AS n, TIMESTAMP_NTZ '2024-01-01 05:00:00' AS t,"
        " array('x') AS l, named_struct('v', true) AS o"
    )
    (row,) = json_rows(frame).collect()
    assert json.loads(row.value) == {"s": "a", "d": None, "n": None, "t": "2024-01-01T05:00:00.000", "l": ["x"], "o": {"v": True}}
