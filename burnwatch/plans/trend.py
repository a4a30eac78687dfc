"""Trend of a value against the row's position in its group: least-squares slope, spread, and the last row.

``spread_trends`` cuts the ordered rows into
range partitions, numbers them within each (group, partition) piece, reduces a piece to its last row and a few moments,
and merges the pieces of a group with each piece's offset, so a group of any size is numbered and summed by many tasks.
It reads its input once and returns the key, ``rows``, ``latest`` (a struct of the wanted columns) and, per value,
``<name>_slope`` (0 where none is defined) and ``<name>_std`` (sample deviation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnwatch.functions import aggregate, named
from burnwatch.plans.scale import range_cuts


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def spread_trends(
    df: DataFrame, key: str, order: Sequence[str], values: dict[str, str], latest: Sequence[str]
) -> DataFrame:
    cut = df.repartitionByRange(*range_cuts(df), F.col(key).asc_nulls_last(), *_ascending(order))
    pieces = cut.withColumn("_piece", F.spark_partition_id())
    return merged_pieces(piece_moments(pieces, key, order, values, latest), key, values)


def piece_moments(
    pieces: DataFrame, key: str, order: Sequence[str], values: dict[str, str], latest: Sequence[str], more: dict[str, str] | None = None
) -> DataFrame:
    """Each (key, ``_piece``) reduced to its number of rows, its last row, and moments of each value and of its place in the piece.

    Pieces of a key follow each other in the order.  ``more`` are further aggregates of the rows of a piece.
    """
    local = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*_ascending(order)))
    moments = {"_rows": "count(1)", "_latest": f"max_by(struct({', '.join(latest)}), _x)"}
    for name, value in values.items():
        x = f"CASE WHEN {value} IS NOT NULL THEN _x END"
        moments |= {
            f"_n_{name}": f"count({value})",
            f"_mx_{name}": f"avg({x})",
            f"_my_{name}": f"avg({value})",
            f"_vx_{name}": f"var_pop({x})",
            f"_vy_{name}": f"var_pop({value})",
            f"_cxy_{name}": f"covar_pop({x}, {value})",
        }
    return aggregate(pieces.withColumn("_x", local.cast("double")), [key, "_piece"], moments | (more or {}))


def merged_pieces(summed: DataFrame, key: str, values: dict[str, str], more: dict[str, str] | None = None) -> DataFrame:
    """Trends of each key from its pieces; ``<name>_mean`` too.  ``more`` are further aggregates over the pieces of a key."""
    # One row per piece from here on: shift the positions by the rows before the piece, then take distances from the mean.
    whole = f"OVER (PARTITION BY {key})"
    before = f"OVER (PARTITION BY {key} ORDER BY _piece ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = summed.selectExpr("*", f"coalesce(sum(_rows) {before}, 0L) AS _offset")
    distances = {}
    for name in values:
        for axis, mean in (("x", f"(_mx_{name} + _offset)"), ("y", f"_my_{name}")):
            total = f"sum(_n_{name} * {mean}) {whole}"
            distances[f"_d{axis}_{name}"] = f"{mean} - try_divide({total}, sum(_n_{name}) {whole})"
    merged = {"rows": "sum(_rows)", "latest": "max_by(_latest, _offset)"}
    for name in values:
        n, dx, dy = f"_n_{name}", f"_dx_{name}", f"_dy_{name}"
        sxx = f"sum({n} * (_vx_{name} + {dx} * {dx}))"
        syy = f"sum({n} * (_vy_{name} + {dy} * {dy}))"
        sxy = f"sum({n} * (_cxy_{name} + {dx} * {dy}))"
        merged[f"{name}_slope"] = f"CASE WHEN {sxx} > 0 THEN try_divide({sxy}, {sxx}) ELSE 0D END"
        merged[f"{name}_std"] = f"CASE WHEN sum({n}) > 1 THEN sqrt({syy} / (sum({n}) - 1)) END"
        merged[f"{name}_mean"] = f"try_divide(sum({n} * _my_{name}), sum({n}))"
    return aggregate(placed.selectExpr("*", *named(distances)), [key], merged | (more or {}))
