"""Streaming rollup of raw events into daily service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.schema import RESPONSE_QUANTILES
from burnwatch.sources.rollup import EventRules, _measures, log_columns, of_both_categories
from burnwatch.streaming.clock import utc_clock, with_instant


def daily_indicators(
    events: DataFrame, rules: EventRules, *, watermark: str = "1 hour", accuracy: int = 10_000
) -> DataFrame:
    """The 83 log columns per service, day and category, emitted once the watermark has passed the day.

    The projection is that of the batch rollup, so operators run on the rows.  The state of a group is a fixed-size sketch and a few
    numbers; percentiles are therefore approximate (relative rank error 1/``accuracy``), unlike those of the batch rollup.
    Events need a time column ``ts``.
    """
    fractions = F.array(*[F.lit(float(p)) for p in RESPONSE_QUANTILES.values()])
    # Rules that ask for the clock time of an event are evaluated before it becomes an instant.
    rows = with_instant(events.selectExpr("*", f"{rules.service} AS _service", *_flags(rules)))
    measures = {name: text for name, text in _measures(rules).items() if name not in ("_err", "_slow", "_late")}
    daily = (
        rows.withWatermark("ts", watermark)
        .groupBy("_service", F.window("ts", "1 day").alias("_day"))
        .agg(
            *[F.expr(f"{text} AS {name}") for name, text in measures.items()],
            *[F.count_if(flag).alias(flag.removesuffix("_flag")) for flag in ("_err_flag", "_slow_flag", "_late_flag")],
            F.percentile_approx(F.expr(rules.value), fractions, F.lit(accuracy)).alias("_q"),
        )
        .withColumn("record_time", utc_clock(F.col("_day.start")))
    )
    return log_columns(of_both_categories(daily, rules), rules)


def _flags(rules: EventRules) -> list[str]:
    return [f"({text}) AS {name}" for name, text in (("_err_flag", rules.error), ("_slow_flag", rules.slow), ("_late_flag", rules.late))]
