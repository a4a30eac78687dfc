"""Exact interpolated quantiles per group, with no group gathered in one task.

The built-in ``percentile`` keeps every distinct value of a group in one task's memory.  ``spread_quantiles`` instead

1. counts each (group, value) pair, combining on the map side, so repeated values of a hot group never travel;
2. puts each pair into a cell that follows from its value alone, 1/4096 of an octave wide, and adds up the rows of each cell, again combining first;
3. adds the counts up along the cells of a group, of which there are some thousands whatever the number of rows, and so finds the cell that
   holds each wanted rank;
4. reads only the pairs inside those cells and walks their running counts.

Steps 2 and 4 start from one exchange of the pairs.  There is one plan for every size, no job of its own to find cuts, and nothing depends on how a run places rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of an octave, and a number above all cells of positive values.
CELLS_OF_OCTAVE, BEYOND = 4096, 10_000_000


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition between two aliased frames in which NULL keys match each other."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def cell(value: str) -> Column:
    """The cell of a value: never falls as the value grows.  Infinite values and NaN, the largest, have cells of their own."""
    size = f"CAST(floor(ln(abs(CAST({value} AS DOUBLE))) * {CELLS_OF_OCTAVE / math.log(2)!r}D) AS INT)"
    return F.expr(
        f"""CASE WHEN {value} = 0 THEN 0 WHEN isnan({value}) THEN {3 * BEYOND}
            WHEN abs({value}) = double('Infinity') THEN CASE WHEN {value} > 0 THEN {3 * BEYOND - 1} ELSE {1 - 3 * BEYOND} END
            WHEN {value} > 0 THEN {BEYOND} + {size} ELSE -{BEYOND} - {size} END"""
    )


def spread_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], output: str, weight: str | None = None
) -> DataFrame:
    """``keys`` plus an array ``output`` with one linearly interpolated quantile per fraction; NULL values are skipped.

    ``weight`` names a column that says how many times each row counts.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pairs = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(rows.alias("_n"))
    )

    pairs = pairs.withColumn("_cell", cell("_value"))
    cells = pairs.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_rows"))
    along = Window.partitionBy(*keys).orderBy("_cell")
    whole = Window.partitionBy(*keys)
    placed = cells.select(
        *keys,
        "_cell",
        "_rows",
        (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"),
    )

    def position(fraction: float) -> Column:
        return F.lit(float(fraction)) * (F.col("_total") - 1)

    ranks = F.array_distinct(
        F.array(*[f(position(p)).cast("bigint") for p in fractions for f in (F.floor, F.ceil)])
    )
    wanted = placed.select(
        *keys,
        "_cell",
        "_before",
        "_total",
        F.filter(
            ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows"))
        ).alias("_ranks"),
    ).filter(F.size("_ranks") > 0)

    inside = (
        pairs.alias("p")
        .join(wanted.alias("w"), same_keys("p", "w", [*keys, "_cell"]))
        .select(*[F.col(f"p.{k}") for k in keys], "_value", "_n", "p._cell", "_before", "_total", "_ranks")
    )
    walk = Window.partitionBy(*keys, "_cell").orderBy("_value")
    reached = inside.withColumn("_end", F.col("_before") + F.sum("_n").over(walk))
    hits = reached.select(
        *keys,
        "_value",
        "_total",
        F.explode(
            F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))
        ).alias("_rank"),
    )
    # At most two ranks per fraction reach this point, so the map of a group is small.
    found = hits.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"),
        F.max("_total").alias("_total"),
    )

    def interpolated(fraction: float) -> Column:
        spot = position(fraction)
        low = F.floor(spot).cast("bigint")
        high = F.ceil(spot).cast("bigint")
        at_low = F.element_at("_at", low)
        return at_low + (spot - low) * (F.element_at("_at", high) - at_low)

    return found.select(*keys, F.array(*[interpolated(p) for p in fractions]).alias(output))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two frames with at most one row per key on the right; NULL keys match each other."""
    extra = [c for c in right.columns if c not in keys]
    return (
        left.alias("l")
        .join(right.alias("r"), same_keys("l", "r", keys), "left")
        .select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in extra])
    )
