"""Trends over days: day over day, week over week, and standard deviation.

Each has a form for a series of values on the driver and one for a DataFrame of daily values.
Both go by the calendar: a missing day isn't bridged by the row before.
"""

from __future__ import annotations

import datetime as dt
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.keys import Err, Ok, fail

Series = dict[dt.date, float]
DAY, WEEK = 1, 7


def _missing(days: list[dt.date]) -> Err:
    shown = ", ".join(d.isoformat() for d in days[:5]) + (", ..." if len(days) > 5 else "")
    return fail(f"There are {len(days)} dates with missing metrics: {shown}")


def change(series: Series, day: dt.date, step: int) -> Ok | Err:
    """The absolute relative change from ``step`` days before."""
    before = day - dt.timedelta(days=step)
    missing = [d for d in (before, day) if series.get(d) is None]
    if missing:
        return _missing(missing)
    if series[before] == 0:
        name, which = ("day over day", "previous day") if step == DAY else ("week over week", "week ago")
        return fail(f"Cannot calculate {name}: {which} value ({series[before]}) is zero.")
    return Ok(abs((series[day] - series[before]) / series[before]))


def deviation(series: Series, day: dt.date, offset: int, n: int) -> Ok | Err:
    """The sample standard deviation of the days from day - offset - n + 1 to day - offset that have a value; 0 for one."""
    days = [day - dt.timedelta(days=offset + k) for k in range(n)]
    values = [series[d] for d in days if series.get(d) is not None]
    if not values:
        return _missing(sorted(days))
    return Ok(statistics.stdev(values) if len(values) > 1 else 0.0)


def _by_day(frame: DataFrame, date: str, keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy(F.unix_date(date))


def change_column(frame: DataFrame, value: str, step: int, date: str = "date", keys: tuple[str, ...] = ()) -> Column:
    """``change`` as a window column; null where there is none."""
    before = F.first(value).over(_by_day(frame, date, keys).rangeBetween(-step, -step))
    return F.abs((F.col(value) - before) / F.nullif(before, F.lit(0.0)))


def deviation_column(frame: DataFrame, value: str, offset: int, n: int, date: str = "date", keys: tuple[str, ...] = ()) -> Column:
    """``deviation`` as a window column; null where no day of the window has a value."""
    window = _by_day(frame, date, keys).rangeBetween(-(offset + n - 1), -offset)
    return F.when(F.count(value).over(window) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value).over(window))


def with_day_over_day(frame: DataFrame, value: str, name: str = "day_over_day", **kw) -> DataFrame:
    return frame.withColumn(name, change_column(frame, value, DAY, **kw))


def with_week_over_week(frame: DataFrame, value: str, name: str = "week_over_week", **kw) -> DataFrame:
    return frame.withColumn(name, change_column(frame, value, WEEK, **kw))


def with_stddev(frame: DataFrame, value: str, offset: int, n: int, name: str = "stddev", **kw) -> DataFrame:
    return frame.withColumn(name, deviation_column(frame, value, offset, n, **kw))
