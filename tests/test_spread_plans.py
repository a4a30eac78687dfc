"""The plans that spread a group over many tasks give the same results as the short ones and as brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnwatch.operators import trends
from pyspark.sql import Window
from burnwatch.plans.quantiles import spread_quantiles
from burnwatch.contract.fixture import EVENT_RULES
from burnwatch.functions import aggregate
from burnwatch.plans.trend import spread_trends
from burnwatch.sources.rollup import daily_tables

def gathered_trends(df, key, order, values, latest):
    """The short form, which numbers the rows with a window over the whole group."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    columns = {"rows": "count(1)", "latest": f"max_by(struct({', '.join(latest)}), _x)"}
    for name, value in values.items():
        columns[f"{name}_slope"] = f"coalesce(regr_slope({value}, _x), 0D)"
        columns[f"{name}_std"] = f"stddev_samp({value})"
    return aggregate(df.withColumn("_x", position.cast("double")), [key], columns)


FRACTIONS = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


def quantiles_of(spark, data, fractions=FRACTIONS):
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    return {row.g: row.q for row in spread_quantiles(df, ["g"], "v", fractions, "q").collect()}


def test_quantiles_with_a_hot_group_and_repeats(spark):
    rng = random.Random(7)
    data = [("hot", rng.choice([rng.random(), 0.5, 0.25])) for _ in range(3000)]
    data += [("same", 4.0)] * 500 + [("one", 1.5), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0)]
    data += [("hot", None), ("void", None)]
    found = quantiles_of(spark, data)
    expected = {}
    for g, v in data:
        if v is not None:
            expected.setdefault(g, []).append(v)
    assert set(found) == set(expected)
    for g, values in expected.items():
        assert found[g] == pytest.approx(list(np.quantile(values, FRACTIONS)), abs=1e-12), g


def test_quantiles_of_negative_and_infinite_values(spark):
    found = quantiles_of(spark, [("a", -1.0), ("a", float("-inf")), ("a", 0.0), ("a", -0.0), ("a", 7.0)], [0.25, 0.5, 1.0])
    assert found["a"] == [-1.0, 0.0, 7.0]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 6)], "g string, v double, w long")
    (row,) = spread_quantiles(df, ["g"], "v", [0.3, 0.5], "q", weight="w").collect()
    assert row.q == pytest.approx(list(np.quantile([1, 1, 1, 2, 9, 9, 9, 9, 9, 9], [0.3, 0.5])))


def test_trends_agree(spark):
    rng = random.Random(3)
    data = [("hot", t // 3, f"i{t:05d}", 0.01 * t + rng.random(), rng.random() if t % 7 else None) for t in range(2500)]
    data += [("few", t, f"i{t}", float(t * t), 1.0) for t in range(4)] + [("one", 0, "i", 2.0, 2.0)]
    df = spark.createDataFrame(data, "s string, t int, id string, y double, z double").repartition(4)
    values = {"y": "y", "z": "z"}
    columns = ["y_slope", "z_slope", "y_std", "z_std", "rows"]
    short, spread = (
        {r.s: r for r in plan(df, "s", ["t", "id"], values, ["id", "y"]).collect()}
        for plan in (gathered_trends, spread_trends)
    )
    assert set(short) == set(spread)
    for s in short:
        assert [spread[s][c] for c in columns] == pytest.approx([short[s][c] for c in columns], abs=1e-9)
        assert spread[s].latest == short[s].latest
    hot = [row for row in data if row[0] == "hot"]
    assert spread["hot"].y_slope == pytest.approx(np.polyfit(range(len(hot)), [r[3] for r in hot], 1)[0], abs=1e-9)
    assert spread["hot"].y_std == pytest.approx(np.std([r[3] for r in hot], ddof=1))
    assert spread["hot"].latest.id == "i02499"
    assert (spread["one"].y_slope, spread["one"].y_std) == (0.0, None)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def rows_of(frame):
    return sorted(frame.collect(), key=lambda r: r[0])


def test_rollup_agrees(events):
    fractions = [25, 50, 75, 80, 85, 90, 95, 99]
    quantiles = [f"round(response_time_p{p}, 9) AS p{p}" for p in fractions]
    spread = daily_tables(events, EVENT_RULES).eb.selectExpr("service_name", "record_time", "total_count", *quantiles)
    arrays = ", ".join(f"{p / 100}D" for p in fractions)
    short = events.groupBy(
        F.expr("concat('svc_', CAST(user_id % 10 AS STRING)) AS service_name"), F.expr("CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS record_time")
    ).agg(F.count("*").alias("total_count"), F.expr(f"percentile(value, array({arrays})) AS q"))
    short = short.selectExpr("service_name", "record_time", "total_count", *[f"round(q[{i}] / 100, 9) AS p{p}" for i, p in enumerate(fractions)])
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, short.collect()))


def test_operators_agree(events):
    t = daily_tables(events, EVENT_RULES, quantiles=False)
    latest = ["error_rate"]
    short = {r.service_name: r for r in gathered_trends(t.eb, "service_name", ["record_time", "id"], {"y": "error_rate"}, latest).collect()}
    for row in trends.service_risk(t).collect():
        assert row.trends.error_rate_slope == pytest.approx(short[row.service_name].y_slope, abs=1e-9)
    exact = t.eb.groupBy("service_name").agg(F.expr("percentile(error_rate, array(0.5D, 0.95D, 0.99D)) AS q"))
    exact = {r.service_name: r.q for r in exact.collect()}
    for row in trends.historical_patterns(t).collect():
        s = row.error_rate_stats
        assert [s.p50, s.p95, s.p99] == pytest.approx(exact[row.service_name])


def test_row_counts_are_exact(spark):
    """Big groups keep every row: the ranks of 0 and 1 are the true extremes."""
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.col("id") * 1.0).alias("v"))
    (row,) = spread_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0], "q").collect()
    assert row.q == [0.0, 24_999.5, 49_999.0]
