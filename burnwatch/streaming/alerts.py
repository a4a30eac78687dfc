"""Burn-rate alerts: state over the windows of each service.

An alert is raised by a window whose burn rate reaches ``raise_at``, is held while windows lie between the two thresholds, and is cleared by a window under
``clear_at``.  In batch the state is the last decisive window so far, and runs of equal state are islands; on a stream it is kept per service.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from burnwatch.functions import aggregate

RAISE_AT, CLEAR_AT = 2.0, 1.0
#: One row per change of state.
CHANGES = "service_name string, window_start timestamp_ntz, change string, burn_rate double"
_STATE = "raised boolean, last timestamp_ntz"


def _decision(raise_at: float, clear_at: float) -> str:
    """Whether a window raises, clears, or (NULL) leaves the state as it is; a window without a rate leaves it."""
    return f"CASE WHEN burn_rate >= {raise_at}D THEN true WHEN burn_rate < {clear_at}D THEN false END"


def _with_state(windows: DataFrame, raise_at: float, clear_at: float) -> DataFrame:
    if not clear_at <= raise_at:
        raise ValueError("an alert cannot be cleared above where it is raised")
    so_far = Window.partitionBy("service_name").orderBy("window_start", "window_end")
    decided = windows.withColumn("_decided", F.expr(_decision(raise_at, clear_at)))
    return decided.withColumn("_raised", F.coalesce(F.last("_decided", ignorenulls=True).over(so_far), F.lit(False)))


def burn_alerts(windows: DataFrame, raise_at: float = RAISE_AT, clear_at: float = CLEAR_AT) -> DataFrame:
    """Alerts over the rows of ``sliding_burn_rate``: from the window that raised one to the window that cleared it.

    One row per alert: ``service_name``, ``raised_at`` and ``cleared_at`` (starts of those windows; NULL while it lasts), ``windows`` it was up for, the highest
    ``peak_burn_rate`` and the window it was reached in, and the worst ``severity``.  A service has one row per slide and not per event, so its
    windows fit a task however many events it has.
    """
    by_time = Window.partitionBy("service_name").orderBy("window_start", "window_end")
    stated = _with_state(windows, raise_at, clear_at)
    stated = stated.withColumn("_starts", F.col("_raised") & ~F.coalesce(F.lag("_raised").over(by_time), F.lit(False)))
    stated = stated.withColumn("_next", F.lead("window_start").over(by_time))
    islands = stated.withColumn("_alert", F.count_if("_starts").over(by_time)).filter("_raised")
    rank = "CASE severity WHEN 'emergency' THEN 3 WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
    return aggregate(
        islands,
        ["service_name", "_alert"],
        {
            "raised_at": "min(window_start)",
            "cleared_at": "max_by(_next, struct(window_start, window_end))",
            "windows": "count(1)",
            "peak_burn_rate": "max(burn_rate)",
            "peak_at": "min_by(window_start, CASE WHEN burn_rate IS NOT NULL THEN struct(-burn_rate, window_start) END)",
            "severity": f"max_by(severity, {rank})",
        },
    ).drop("_alert")


def alert_changes(windows: DataFrame, raise_at: float = RAISE_AT, clear_at: float = CLEAR_AT) -> DataFrame:
    """Each window that raises or clears an alert: ``service_name``, ``window_start``, ``change`` (raised or cleared), ``burn_rate``.

    Over a batch the windows are ordered by time.  Over a stream of finished windows (append mode, after the watermark) the state of a service is one flag; a window that comes
    after a later one of its service was judged is passed over.
    """
    if not windows.isStreaming:
        by_time = Window.partitionBy("service_name").orderBy("window_start", "window_end")
        stated = _with_state(windows, raise_at, clear_at).withColumn("_before", F.coalesce(F.lag("_raised").over(by_time), F.lit(False)))
        changed = stated.filter("_raised <> _before")
        return changed.select("service_name", "window_start", F.expr("CASE WHEN _raised THEN 'raised' ELSE 'cleared' END AS change"), "burn_rate")
    if not clear_at <= raise_at:
        raise ValueError("an alert cannot be cleared above where it is raised")

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raised, last = state.get if state.exists else (False, None)
        rows = pd.concat(frames).sort_values("window_start")
        out = []
        for start, rate in zip(rows["window_start"], rows["burn_rate"], strict=True):
            if last is not None and start <= last:
                continue
            last = start
            now = True if rate >= raise_at else False if rate < clear_at else raised
            if now != raised:
                out.append((key[0], start, "raised" if now else "cleared", rate))
            raised = now
        state.update((raised, last))
        yield pd.DataFrame(out, columns=["service_name", "window_start", "change", "burn_rate"])

    slim = windows.select("service_name", "window_start", "burn_rate")
    return slim.groupBy("service_name").applyInPandasWithState(judge, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)
