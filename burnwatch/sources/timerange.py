"""Day-aligned time ranges for a refresh."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta



def resolve_range(
    today: date,
    *,
    last_days: int | None = 7,
    start: date | None = None,
    end: date | None = None,
    max_days: int | None = None,
) -> tuple[datetime, datetime]:
    """``[start of first day, start of the day after the last)``: the last days up to today, or the given dates.

    ``max_days`` refuses longer ranges; by default a range may have any length.
    """
    if start is not None or end is not None:
        if start is None or end is None:
            raise ValueError("give both a start and an end date")
        low, high = start, end + timedelta(days=1)
    else:
        if last_days is None or last_days < 0:
            raise ValueError("last_days must be a number of days")
        low, high = today - timedelta(days=last_days), today + timedelta(days=1)
    if max_days is not None and (high - low).days > max_days:
        raise ValueError(f"the range cannot exceed {max_days} days")
    if high <= low:
        raise ValueError("the end date must be after the start date")
    return datetime.combine(low, time.min), datetime.combine(high, time.min)


def epoch_millis(moment: datetime) -> int:
    """Epoch milliseconds of a naive local time."""
    return int(moment.timestamp() * 1000)
