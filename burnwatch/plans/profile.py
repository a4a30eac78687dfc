"""Per-service aggregates over both log categories in one pass.

The combined reports are defined on error-budget rows left-joined to response rows by service name.  With m rows on one
side and n on the other that join makes m*n rows, which leaves AVG and MAX of either side unchanged and multiplies an
error-budget SUM by max(n, 1).  Here nothing is joined: both categories are aggregated together by service
name with a condition on the category, and the factor is applied to the sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from burnwatch.functions import aggregate
from burnwatch.functions.health import worst_health
from burnwatch.plans.tables import SloTables, for_service
from burnwatch.schema import EB, RESPONSE

EB_ROWS = "_eb_rows"
RESPONSE_ROWS = "_response_rows"


class Side:
    """Aggregates over the rows of one category."""

    def __init__(self, category: str):
        self.rows = f"data_category = '{category}'"

    def avg(self, column: str) -> str:
        return f"avg(CASE WHEN {self.rows} THEN {column} END)"

    def max(self, column: str) -> str:
        return f"max(CASE WHEN {self.rows} THEN {column} END)"

    def sum(self, column: str) -> str:
        return f"sum(CASE WHEN {self.rows} THEN {column} END)"

    def worst(self, column: str) -> str:
        return worst_health(column, self.rows)


eb = Side(EB)
resp = Side(RESPONSE)


def service_profile(
    tables: SloTables,
    aggregates: dict[str, str],
    *,
    service_name: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda logs: logs,
) -> DataFrame:
    """One row per service that has error-budget rows, with the given aggregates and both row counts.

    ``prepare`` may add columns to the rows for the aggregates to use.  A NULL name forms a group of its own on the
    error-budget side and never matches a response row.
    """
    usable = f"{eb.rows} OR ({resp.rows} AND service_name IS NOT NULL)"
    counts = {EB_ROWS: f"count_if({eb.rows})", RESPONSE_ROWS: f"count_if({resp.rows})"}
    rows = prepare(for_service(tables.logs, service_name).filter(usable))
    return aggregate(rows, ["service_name"], counts | aggregates).filter(f"{EB_ROWS} > 0")


def joined_sum(total: str, *, dedupe_volume: bool = False) -> str:
    """An error-budget SUM as the row product of both sides gives it; ``dedupe_volume`` keeps the plain sum.

    The product of a sum and a row count can pass 64 bits, so it is taken in 38 digits and handed out as a DOUBLE.
    """
    rows = "1" if dedupe_volume else f"greatest({RESPONSE_ROWS}, 1)"
    return f"CAST(CAST({total} AS DECIMAL(38, 0)) * {rows} AS DOUBLE)"
