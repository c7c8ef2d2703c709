"""Datasets: a DataFrame, or a function that gives one for a day and parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.keys import ProbitasError

DATE = "__probitas_date"
Filters = dict[str, Callable[[Any], Column]]


class FrameSource:
    """A named dataset.

    frame: a DataFrame, or a function (date, parameters) -> DataFrame for datasets that know how
    to find a day's rows.  date_col: the column, or expression, that holds a row's day; without
    it a DataFrame has the same rows on any day, and lags are refused.  skip_dates: days that
    aren't available and count against the data-availability threshold.  parameter_filters: for
    each parameter a function from its value to a row condition.
    """

    def __init__(
        self,
        frame: DataFrame | Callable[[dt.date, dict[str, Any]], DataFrame],
        name: str,
        date_col: str | None = None,
        skip_dates: Iterable[dt.date] = (),
        parameter_filters: Filters | None = None,
    ):
        if not name or not name.strip():
            raise ValueError("A source needs a name")
        self.frame, self.name, self.date_col = frame, name, date_col
        self.skip_dates = frozenset(skip_dates)
        self.parameter_filters = dict(parameter_filters or {})

    @classmethod
    def from_arrow(cls, spark: SparkSession, data: Any, name: str, **kw: Any) -> FrameSource:
        """A source of an Arrow table or record batch."""
        import pyarrow as pa

        table = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
        return cls(spark.createDataFrame(table), name, **kw)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, name: str, format: str = "parquet", options: dict[str, str] | None = None, **kw: Any) -> FrameSource:
        """A source of files in any format that Spark reads."""
        return cls(spark.read.format(format).options(**(options or {})).load(path), name, **kw)

    @property
    def by_date(self) -> bool:
        """Whether different days have different rows."""
        return callable(self.frame) or self.date_col is not None

    @property
    def schema(self):
        """The schema before any filter."""
        return (self.frame(dt.date.today(), {}) if callable(self.frame) else self.frame).schema

    def condition(self, parameters: dict[str, Any]) -> Column | None:
        """The row condition that the parameters stand for; None for no parameters."""
        unknown = [p for p in parameters if p not in self.parameter_filters]
        if unknown and not callable(self.frame):
            raise ProbitasError(f"{self.name} has no filter for parameter(s) {', '.join(sorted(unknown))}")
        conditions = [self.parameter_filters[p](v) for p, v in parameters.items() if p in self.parameter_filters]
        return reduce(lambda a, b: a & b, conditions) if conditions else None

    def rows(self, dates: list[dt.date], parameters: dict[str, Any] | None = None) -> DataFrame:
        """The rows of the days, with the day in the column DATE.

        A date column is compared as a range, so the filter reaches the scan and partitions are
        pruned; the days themselves are then picked from the range.
        """
        parameters = parameters or {}
        dates = sorted(set(dates))
        if callable(self.frame):
            parts = [self.frame(d, parameters).withColumn(DATE, F.lit(d)) for d in dates]
            return reduce(lambda a, b: a.unionByName(b), parts)
        frame = self.frame
        if self.date_col is None:
            if len(dates) > 1:
                raise ProbitasError(f"{self.name} has no date column, so it has no values for other days: {', '.join(map(str, dates))}")
            frame = frame.withColumn(DATE, F.lit(dates[0]))
        else:
            day = F.to_date(F.expr(self.date_col))
            frame = frame.where(F.expr(self.date_col) >= F.lit(dates[0])).where(F.expr(self.date_col) < F.lit(dates[-1] + dt.timedelta(days=1))).withColumn(DATE, day)
            if len(dates) <= (dates[-1] - dates[0]).days:
                frame = frame.where(F.col(DATE).isin(*dates))
        condition = self.condition(parameters)
        return frame if condition is None else frame.where(condition)
