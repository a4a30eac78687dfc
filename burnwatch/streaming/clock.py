"""Event times without a zone on a stream.

Watermarks need instants.  A zone-less time is taken as UTC on the way in and given back as UTC on the way out, so the
session's zone does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_instant(events: DataFrame, column: str = "ts") -> DataFrame:
    if events.schema[column].dataType.typeName() != "timestamp_ntz":
        return events
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return events.withColumn(column, local.cast("timestamp"))


def utc_clock(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
