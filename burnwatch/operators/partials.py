"""Risk and history from stored figures per service and hour instead of the logs.

``partials`` reduces the error-budget logs to one row per service and hour, which a load can append for its own days.  Everything in a row merges: counts and extremes, moments of values
and of their places in the hour (places are shifted by the rows before, so slopes over the whole history come out as from the logs), and quantile sketches of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.functions import aggregate
from burnwatch.functions.scoring import or_zero, or_zero_count
from burnwatch.operators.trends import LATEST, TREND_ORDER, TREND_VALUES, judged
from burnwatch.plans.quantiles import join_on_keys
from burnwatch.plans.tables import PARTITION, SloTables
from burnwatch.plans.trend import merged_pieces, piece_moments

_KEY = "service_name"
#: Size of a quantile sketch. The rank of what it answers is off by less than RANK_ERROR of the rows, 99 times in 100; measured in the tests.
SKETCH_K, RANK_ERROR = 800, 0.005
_QUANTILES = (0.5, 0.95, 0.99)


def partials(tables: SloTables, k: int = SKETCH_K) -> DataFrame:
    """One row per service and hour of the error-budget logs, with the day to partition a stored table by."""
    rows = tables.eb.select(_KEY, "record_time", "id", *LATEST, "response_time_min", "response_time_max").withColumn(
        "_piece", F.expr("timestampadd(HOUR, hour(record_time), CAST(CAST(record_time AS DATE) AS TIMESTAMP_NTZ))")
    )
    more = {
        "_start": "min(record_time)",
        "_end": "max(record_time)",
        "_error_min": "min(error_rate)",
        "_error_max": "max(error_rate)",
        "_response_min": "min(response_time_min)",
        "_response_max": "max(response_time_max)",
        "_requests": "sum(total_count)",
        "_counted": "count(total_count)",
        "_peak": "max(total_count)",
        "_least": "min(total_count)",
        "_error_sketch": f"kll_sketch_agg_double(error_rate, {k})",
        "_response_sketch": f"kll_sketch_agg_double(response_time_avg, {k})",
    }
    return piece_moments(rows, _KEY, TREND_ORDER, TREND_VALUES, LATEST, more).withColumn(PARTITION, F.col("_piece").cast("date"))


def risk_from(stored: DataFrame) -> DataFrame:
    """``service_risk`` of the logs that the rows were made of."""
    return judged(merged_pieces(stored, _KEY, TREND_VALUES))


def history_from(stored: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """``historical_patterns`` of the logs that the rows were made of; p50, p95 and p99 come from merged sketches (see ``RANK_ERROR``) and are members of the data.

    Sketches of a key merge on the map side too, and their size does not grow with the rows.
    """
    totals = {
        "data_points": "sum(_rows)",
        "time_range": "struct(min(_start) AS start, max(_end) AS end)",
        **{f"_{name}_{end}": f"{end}(_{name}_{end})" for name in TREND_VALUES for end in ("min", "max")},
        "traffic_stats": f"""struct({or_zero_count("sum(_requests)")} AS total_requests, {or_zero("try_divide(CAST(sum(_requests) AS DOUBLE), sum(_counted))")} AS avg_requests_per_period,
            {or_zero_count("max(_peak)")} AS peak_requests, {or_zero_count("min(_least)")} AS min_requests)""",
        **{f"_{name}_sketch": f"kll_merge_agg_double(_{name}_sketch, {k})" for name in TREND_VALUES},
    }
    frame = merged_pieces(stored, _KEY, TREND_VALUES, totals)
    by_hour = aggregate(
        stored.filter("_piece IS NOT NULL").selectExpr("*", "hour(_piece) AS hour"),
        [_KEY, "hour"],
        {
            **{column: f"try_divide(sum(_n_{name} * _my_{name}), sum(_n_{name}))" for name, column in TREND_VALUES.items()},
            "total_count": or_zero_count("sum(_requests)"),
        },
    )
    entry = "struct(hour, struct(error_rate, response_time_avg, total_count))"
    hourly = aggregate(by_hour, [_KEY], {"hourly_patterns": f"map_from_entries(sort_array(collect_list({entry})))"})
    return join_on_keys(frame, hourly, [_KEY]).selectExpr(
        _KEY,
        "data_points",
        "time_range",
        f"{_stats('error')} AS error_rate_stats",
        f"{_stats('response')} AS response_time_stats",
        "traffic_stats",
        "hourly_patterns",
    )


def _stats(name: str) -> str:
    quantiles = ", ".join(
        f"CASE WHEN kll_sketch_get_n_double(_{name}_sketch) > 0 THEN kll_sketch_get_quantile_double(_{name}_sketch, {p}D) END AS p{round(100 * p)}"
        for p in _QUANTILES
    )
    return f"struct({name}_mean AS mean, {name}_std AS std, _{name}_min AS min, _{name}_max AS max, {quantiles})"
