"""Rules as SQL expression text: health rollup, change, severity and formatting.

Expressions are built as text and handed to Spark once per list of columns (``selectExpr``), which keeps plan building
cheap for operators with many columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(columns: dict[str, str]) -> list[str]:
    """``expression AS name`` for each entry."""
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def number(value: float) -> str:
    """A numeric literal of the value's own type; plain decimals would read as DECIMAL."""
    return f"{value}D" if isinstance(value, float) else str(value)


def aggregate(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Group by the keys and compute the named aggregates."""
    return df.groupBy(*keys).agg(*[F.expr(text) for text in named(columns)])
