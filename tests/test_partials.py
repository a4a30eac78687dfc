"""Risk and history from stored figures, sketches, answers for services asked for, and cells of values."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnwatch.operators import partials, trends
from burnwatch.plans.quantiles import BEYOND, CELLS_OF_OCTAVE, cell, spread_quantiles
from burnwatch.registry import answered, ask, run

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(tables):
    """Two services, one with most rows, over hours that are empty, single, or full."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        service = "hot" if i % 9 else "cold"
        rows.append(
            {
                "id": f"{service}{i}",
                "service_name": service,
                "record_time": START + timedelta(minutes=rng.choice((7, 61, 600)) * (i % 200)),
                "error_rate": None if i % 50 == 3 else rng.lognormvariate(0, 1),
                "response_time_avg": rng.random(),
                "response_time_min": rng.random() / 2,
                "response_time_max": 1 + rng.random(),
                "total_count": None if i % 70 == 1 else rng.randint(0, 1000),
            }
        )
    rows += [{"id": "n", "service_name": None, "record_time": START, "error_rate": 1.0}, {"id": "t", "service_name": "cold", "record_time": None, "error_rate": 3.0}]
    return tables(rows)


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


def keyed(df, *drop):
    return {r.service_name: tuple(r[c] for c in df.columns if c not in drop) for r in df.collect()}


def test_risk_from_stored_figures_is_that_of_the_logs(history):
    stored = partials.partials(history)
    found, wanted = keyed(partials.risk_from(stored)), keyed(trends.service_risk(history))
    assert set(found) == set(wanted) and all(near(found[k], wanted[k]) for k in wanted)


def test_rows_of_days_appended_one_by_one_give_the_same(history):
    days = [r.d for r in history.eb.selectExpr("CAST(record_time AS DATE) AS d").distinct().collect()]
    from burnwatch.plans.tables import SloTables

    def of(day):
        return partials.partials(SloTables.from_pair(history.eb.filter(F.col("record_time").cast("date").eqNullSafe(F.lit(day))), history.resp))

    pieces = of(days[0])
    for day in days[1:3]:
        pieces = pieces.unionByName(of(day))
    some = history.eb.filter(F.coalesce(*[F.col("record_time").cast("date").eqNullSafe(F.lit(d)) for d in days[:1]]) | F.col("record_time").cast("date").eqNullSafe(F.lit(days[1])) | F.col("record_time").cast("date").eqNullSafe(F.lit(days[2])))
    found, wanted = keyed(partials.risk_from(pieces)), keyed(trends.service_risk(SloTables.from_pair(some, history.resp)))
    assert set(found) == set(wanted) and all(near(found[k], wanted[k]) for k in wanted)


def test_history_from_stored_figures(history):
    found = {r.service_name: r for r in partials.history_from(partials.partials(history)).collect()}
    wanted = {r.service_name: r for r in trends.historical_patterns(history).collect()}
    assert set(found) == set(wanted)
    for name, row in wanted.items():
        got = found[name]
        for part in ("error_rate_stats", "response_time_stats"):
            for key in ("mean", "std", "min", "max"):
                assert near(got[part][key], row[part][key]), (name, part, key)
        assert near(tuple(got.traffic_stats), tuple(row.traffic_stats)) and got.data_points == row.data_points and got.time_range == row.time_range
        assert set(got.hourly_patterns) == set(row.hourly_patterns)
        for hour, pattern in row.hourly_patterns.items():
            assert near(tuple(got.hourly_patterns[hour]), tuple(pattern))


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "repeats", "sorted"])
def test_the_rank_error_of_merged_sketches(spark, shape):
    """Measured: 200 sketches of 500 values each, merged."""
    value = {
        "uniform": "rand(3)",
        "lognormal": "exp(2 * randn(3))",
        "repeats": "floor(20 * rand(3)) + 0D",
        "sorted": "id + 0D",
    }[shape]
    rows = spark.range(100_000).selectExpr(f"CAST({value} AS DOUBLE) AS v", "id % 200 AS part").persist()
    sketches = rows.groupBy("part").agg(F.expr(f"kll_sketch_agg_double(v, {partials.SKETCH_K})").alias("s"))
    fractions = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    merged = sketches.agg(F.expr(f"kll_merge_agg_double(s, {partials.SKETCH_K})").alias("s"))
    found = merged.selectExpr(*[f"kll_sketch_get_quantile_double(s, {p}D)" for p in fractions]).first()
    values = np.sort(np.array([r.v for r in rows.collect()]))
    for p, q in zip(fractions, found, strict=True):
        low, high = np.searchsorted(values, q, "left") / len(values), np.searchsorted(values, q, "right") / len(values)
        assert low - partials.RANK_ERROR <= p <= high + partials.RANK_ERROR, (p, low, high)
    rows.unpersist()


def test_a_record_for_each_service_asked_for(tables):
    t = tables([{"id": "a", "service_name": "a", "record_time": START, "error_count": 1, "total_count": 10}, {"id": "b", "service_name": "b", "record_time": START}])
    rows = {r.service_name: r for r in ask("calculate_error_budget", t, ["a", "zz"], as_of=START).collect()}
    assert rows["a"].error is None and rows["a"].total_requests == 10
    assert rows["zz"].error == "No data found for this service" and rows["zz"].total_requests is None
    (row,) = ask("get_historical_patterns", t, "zz").collect()
    assert row.error == "No data found for service zz" and row.data_points is None
    (row,) = ask("get_volume_trends", t, "zz").collect()
    assert row.error == "No data found for service zz"
    (row,) = ask("get_service_summary", t, "zz").collect()
    assert row.error == "No data found for this service"
    # A window of the service without rows keeps its own text inside the summary.
    (row,) = ask("get_service_summary", t, "a", as_of=START + timedelta(days=9)).collect()
    assert row.error is None and row.error_budget.error == "No data found for this service"
    assert ask("calculate_error_budget", t, ["a", "a", "zz"], as_of=START).count() == 2
    assert answered(run("calculate_error_budget", t, as_of=START), []).count() == 0


def test_volume_trends_of_one_service_end_at_the_newest_record_of_all(tables):
    t = tables([{"id": "a", "service_name": "a", "record_time": START}, {"id": "b", "service_name": "b", "record_time": START + timedelta(days=1)}])
    (row,) = ask("get_volume_trends", t, "a", time_window_minutes=60).collect()
    assert row.error == "No data found for service a"


VALUES = st.one_of(st.floats(allow_nan=False), st.sampled_from([0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, 1.0, 2.0, 1 + 2**-52]))


def test_cells_never_fall_as_values_grow(spark):
    @settings(max_examples=20, deadline=None)
    @given(st.lists(VALUES, min_size=2, max_size=200))
    def check(values):
        data = [(v,) for v in sorted(values)]
        cells = [r.c for r in spark.createDataFrame(data, "v double").coalesce(1).select(cell("v").alias("c")).collect()]
        assert cells == sorted(cells)

    check()
    octave = [r.c for r in spark.sql("SELECT explode(array(1D, 2D, 4D)) AS v").select(cell("v").alias("c")).collect()]
    assert [b - a for a, b in zip(octave, octave[1:], strict=False)] == [CELLS_OF_OCTAVE] * 2 and octave[0] == BEYOND


def test_quantiles_of_values_in_one_cell_and_over_many(spark):
    rng = random.Random(9)
    data = [("one", 1e9 + rng.random()) for _ in range(2000)] + [("wide", rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300)) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    fractions = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = {r.g: r.q for r in spread_quantiles(df, ["g"], "v", fractions, "q").collect()}
    for g in ("one", "wide"):
        assert found[g] == pytest.approx(list(np.quantile([v for k, v in data if k == g], fractions)), rel=1e-12)
