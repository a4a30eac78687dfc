"""Burn rate over sliding windows of raw events; the same plan runs on a batch and on a stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnwatch.functions.scoring import burn_severity, ratio_or_zero
from burnwatch.sources.rollup import EventRules
from burnwatch.streaming.clock import utc_clock, with_instant


def common_step(spark: SparkSession, window: str, slide: str) -> str:
    """The longest step that divides both the window and the slide."""
    sizes = spark.sql(
        "SELECT extract(DAY FROM w) * 86400000000L + extract(HOUR FROM w) * 3600000000L + extract(MINUTE FROM w) * 60000000L"
        " + CAST(extract(SECOND FROM w) * 1000000 AS BIGINT) AS n FROM VALUES"
        f" (CAST(INTERVAL '{window}' AS INTERVAL DAY TO SECOND)), (CAST(INTERVAL '{slide}' AS INTERVAL DAY TO SECOND)) AS t(w)"
    ).collect()
    return f"{math.gcd(*(row.n for row in sizes))} microseconds"


def sliding_burn_rate(
    events: DataFrame,
    rules: EventRules,
    *,
    window: str = "1 hour",
    slide: str = "5 minutes",
    watermark: str | None = None,
) -> DataFrame:
    """Requests, errors, burn rate and its severity per service and sliding window over events with a time column ``ts``.

    Events are first counted per step, so that the overlapping windows expand those counts and not the events.  On a
    stream give a ``watermark``; rows later than it are dropped.
    """
    instants = with_instant(events)
    # A step that divides both keeps every slice inside the windows that it touches.
    step = common_step(events.sparkSession, window, slide)
    rows = instants if watermark is None else instants.withWatermark("ts", watermark)
    slices = rows.groupBy(F.expr(rules.service).alias("_service"), F.window("ts", step).alias("_slice")).agg(
        F.count(F.lit(1)).alias("_n"), F.expr(f"count_if({rules.error}) AS _err")
    )
    windows = slices.groupBy("_service", F.window(F.window_time("_slice"), window, slide).alias("_window")).agg(
        F.sum("_n").alias("total_requests"), F.sum("_err").alias("total_errors")
    )
    rated = windows.selectExpr(
        "*", f"{ratio_or_zero('total_errors', 'total_requests')} * 100 AS actual", f"CAST({rules.error_target} AS DOUBLE) AS target"
    )
    return rated.select(
        F.col("_service").alias("service_name"),
        utc_clock(F.col("_window.start")).alias("window_start"),
        utc_clock(F.col("_window.end")).alias("window_end"),
        "total_requests",
        "total_errors",
        F.col("actual").alias("actual_error_rate"),
        F.col("target").alias("error_slo_target"),
        F.expr("actual / target AS burn_rate"),
        F.expr(f"{burn_severity('actual / target')} AS severity"),
    )
