"""The two log tables and the scans over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnwatch.schema import EB, RESPONSE

Frame = DataFrame | Callable[[], DataFrame]
TimeLike = datetime | str | Column | None

# Day partition of stored tables; not part of the record.
PARTITION = "record_date"


class SloTables:
    """Error-budget logs, response logs, and both in one frame told apart by ``data_category``.

    Operators that combine both sides read ``logs`` once and aggregate it with per-category conditions, so that
    they need one shuffle and no join.  A frame may be given as a function that builds it when it is first used.
    ``newest_day`` is the newest day partition of the error-budget logs where the store knows it.
    """

    def __init__(self, eb: Frame, resp: Frame, logs: Frame, newest_day: date | None = None):
        self._frames = {EB: eb, RESPONSE: resp, "both": logs}
        self.newest_day = newest_day

    def _frame(self, name: str) -> DataFrame:
        if not isinstance(self._frames[name], DataFrame):
            self._frames[name] = self._frames[name]()
        return self._frames[name]

    @property
    def eb(self) -> DataFrame:
        return self._frame(EB)

    @property
    def resp(self) -> DataFrame:
        return self._frame(RESPONSE)

    @property
    def logs(self) -> DataFrame:
        return self._frame("both")

    def latest_time(self) -> Column:
        """The newest record time of the error-budget logs; where the newest day is known, only that day is read for it."""
        logs = self.eb if self.newest_day is None else self.eb.filter(F.col(PARTITION) == F.lit(self.newest_day))
        return latest_time(logs)

    @classmethod
    def from_pair(cls, eb: DataFrame, resp: DataFrame, newest_day: date | None = None) -> SloTables:
        eb = eb.withColumn("data_category", F.lit(EB))
        resp = resp.withColumn("data_category", F.lit(RESPONSE))
        return cls(eb, resp, lambda: eb.unionByName(resp), newest_day)

    @classmethod
    def from_logs(cls, logs: DataFrame) -> SloTables:
        category = F.col("data_category")
        return cls(logs.filter(category == EB), logs.filter(category == RESPONSE), logs)


def as_time(value: TimeLike) -> Column | None:
    if value is None or isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp_ntz")


def latest_time(logs: DataFrame) -> Column:
    """The newest record time as a scalar subquery: no driver round trip, usable in pushed-down filters."""
    return logs.agg(F.max("record_time").alias("max_time")).scalar()


def minutes(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n * 60))


def in_time_range(logs: DataFrame, start: Column | None, end: Column | None, *, closed: bool = True) -> DataFrame:
    """Records between two times, the end included unless not ``closed``.  On a table partitioned by ``record_date`` the days are pruned too."""
    until = (lambda c, b: c <= b) if closed else (lambda c, b: c < b)
    for bound, keep, keep_day in ((start, lambda c, b: c >= b, lambda c, b: c >= b), (end, until, lambda c, b: c <= b)):
        if bound is not None:
            logs = logs.filter(keep(F.col("record_time"), bound))
            if PARTITION in logs.columns:
                logs = logs.filter(keep_day(F.col(PARTITION), bound.cast("date")))
    return logs


def for_service(logs: DataFrame, service_name: str | None) -> DataFrame:
    return logs.filter(F.col("service_name") == F.lit(service_name)) if service_name else logs


def service_logs(
    tables: SloTables,
    service_name: str | None = None,
    start_time: TimeLike = None,
    end_time: TimeLike = None,
    limit: int | None = None,
) -> DataFrame:
    """Error-budget records, newest first; both time bounds are inclusive and an empty argument means no filter."""
    start, end = (None if isinstance(t, str) and not t else as_time(t) for t in (start_time, end_time))
    logs = in_time_range(for_service(tables.eb, service_name), start, end).drop(PARTITION)
    logs = logs.orderBy(F.col("record_time").desc_nulls_last(), F.col("id").desc_nulls_last())
    return logs.limit(limit) if limit else logs


def all_services(tables: SloTables) -> DataFrame:
    return tables.eb.select("service_name").distinct().orderBy(F.col("service_name").asc_nulls_last())


def time_range(tables: SloTables) -> DataFrame:
    return tables.eb.agg(F.min("record_time").alias("min_time"), F.max("record_time").alias("max_time"))


def run_sql(tables: SloTables, sql: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Ad-hoc Spark SQL over views ``service_logs_eb`` and ``service_logs_response``; values go in as ``:name`` args."""
    tables.eb.createOrReplaceTempView("service_logs_eb")
    tables.resp.createOrReplaceTempView("service_logs_response")
    return tables.eb.sparkSession.sql(sql, args=dict(args or {}))
