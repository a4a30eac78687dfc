"""How finely to cut a frame into ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

RANGE_BYTES = 512 * 1024 * 1024
# The optimizer stands in a huge number for a size it does not know.
UNKNOWN_BYTES = 2**60


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate for the plan, the one it checks against the broadcast threshold; None if unknown."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:  # no classic JVM plan at hand
        return None
    return size if size < UNKNOWN_BYTES else None


def range_cuts(df: DataFrame) -> list[int]:
    """How many ranges to cut a frame into, as the leading argument of ``repartitionByRange``.

    The plan is the same for every size. At least the session's shuffle partitions, and more when that would make ranges too big for a task to sort in memory.
    """
    size = plan_bytes(df)
    if size is None:
        return []
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [max(configured, math.ceil(size / RANGE_BYTES))]
