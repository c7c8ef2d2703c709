"""Computes the metrics of a dataset with as few scans as possible.

All metrics of all days are one ``groupBy(day).agg(...)``.  Metrics with parameters are folded
into the same scan with conditional aggregates, where that means the same as filtering the rows;
the others are one filtered aggregation for each set of parameters.  Exact percentiles, which no
bounded aggregate has, are selected in two passes of their own.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.keys import Err, Ok, ProbitasError, fail
from probitas.operators.metrics import Metric, empty_value
from probitas.operators.selection import exact_percentiles
from probitas.sources.frame import DATE, FrameSource

Request = tuple[dt.date, Metric]


def _thaw(parameters: tuple) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in parameters}


#: Distinct counts of so many different columns share an aggregation, which then shuffles each row that often.
MAX_DISTINCT = 2


class Planner:
    """max_distinct_per_job: so many distinct counts of different columns share an aggregation (each multiplies the rows that are shuffled); None for no bound."""

    def __init__(self, source: FrameSource, max_distinct_per_job: int | None = MAX_DISTINCT):
        self.source, self.max_distinct = source, max_distinct_per_job

    def groups(self, metrics: Iterable[Metric]) -> list[tuple[tuple, list[Metric]]]:
        """(parameters that filter the rows, metrics) for each aggregation."""
        metrics = list(dict.fromkeys(metrics))
        out: dict[tuple, list[Metric]] = {}
        folds = not callable(self.source.frame)
        for m in metrics:
            out.setdefault(() if folds and m.spec.filterable else m.parameters, []).append(m)
        groups = []
        for parameters, members in out.items():
            distinct = [m for m in members if m.spec.distinct]
            inputs = list(dict.fromkeys((m.inputs, m.parameters) for m in distinct))
            if self.max_distinct is None or len(inputs) <= self.max_distinct:
                groups.append((parameters, members))
                continue
            rest = [m for m in members if not m.spec.distinct]
            if rest:
                groups.append((parameters, rest))
            for k in range(0, len(inputs), self.max_distinct):
                some = set(inputs[k : k + self.max_distinct])
                groups.append((parameters, [m for m in distinct if (m.inputs, m.parameters) in some]))
        return groups

    def frames(self, dates: list[dt.date], metrics: Iterable[Metric]) -> list[tuple[list[Metric], DataFrame]]:
        """For each aggregation its metrics and a DataFrame of (DATE, m0, m1, ...)."""
        out = []
        for parameters, members in self.groups(metrics):
            rows = self.source.rows(dates, _thaw(parameters))
            where = {}
            for m in members:
                m.validate(rows)
                where[m] = self.source.condition(_thaw(m.parameters)) if m.parameters != parameters else None
            exact = [m for m in members if m.kind == "percentile"]
            rest = [m for m in members if m.kind != "percentile"]
            if exact:
                wanted = {f"m{k}": (m.row_value(where[m]), m.args[1]) for k, m in enumerate(exact)}
                found = exact_percentiles(rows, DATE if self.source.by_date else None, wanted)
                out.append((exact, found if self.source.by_date else found.withColumn(DATE, F.lit(dates[0]))))
            columns = [m.column(where[m]).alias(f"m{k}") for k, m in enumerate(rest)]
            if rest and self.source.by_date:
                out.append((rest, rows.groupBy(DATE).agg(*columns)))
            elif rest:  # one day, so one group, which has a row even without input
                out.append((rest, rows.drop(DATE).agg(*columns).withColumn(DATE, F.lit(dates[0]))))
        return out

    def table(self, dates: list[dt.date], metrics: dict[str, Metric]) -> DataFrame:
        """(date, a column for each name), with a row for each of the days, also those without rows."""
        dates = sorted(set(dates))
        names = {m: n for n, m in metrics.items()}
        if not self.source.by_date:
            if len(dates) > 1:
                raise ProbitasError(f"{self.source.name} has no date column, so it has no values for other days")
            parts = [f.select(*(F.col(f"m{k}").alias(names[m]) for k, m in enumerate(members))) for members, f in self.frames(dates, metrics.values())]
            row = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
            return row.select(F.lit(dates[0]).alias("date"), *(F.col(f"`{names[m]}`").alias(n) for n, m in metrics.items()))
        frames = self.frames(dates, metrics.values())
        joined = frames[0][1].sparkSession.createDataFrame([(d,) for d in dates], "date date")
        for members, frame in frames:
            joined = joined.join(F.broadcast(frame.withColumn("__there", F.lit(True))), joined["date"] == frame[DATE], "left").drop(DATE)
            for k, m in enumerate(members):
                empty = empty_value(m)
                value = F.col(f"m{k}") if empty is None else F.when(F.col("__there").isNull(), F.lit(empty)).otherwise(F.col(f"m{k}"))
                joined = joined.withColumn(names[m], value).drop(f"m{k}")
            joined = joined.drop("__there")
        # two names for one metric
        return joined.select("date", *(F.col(names[m]).alias(n) for n, m in metrics.items()))

    def run(self, requests: Iterable[Request]) -> dict[Request, Ok | Err]:
        """The outcome of each request; what has no value, or isn't a number, fails by itself."""
        requests = list(dict.fromkeys(requests))
        if not requests:
            return {}
        values: dict[Request, float | None] = {}
        # metrics that are wanted for the same days share an aggregation
        by_dates: dict[frozenset, list[Metric]] = {}
        wanted: dict[Metric, set[dt.date]] = {}
        for day, metric in requests:
            wanted.setdefault(metric, set()).add(day)
        days = set().union(*wanted.values())
        if callable(self.source.frame) or len(days) > 1 and not self.source.by_date:
            for metric, own in wanted.items():
                by_dates.setdefault(frozenset(own), []).append(metric)
        else:
            by_dates[frozenset(days)] = list(wanted)
        for own, metrics in by_dates.items():
            for members, frame in self.frames(sorted(own), metrics):
                found = {row[DATE]: row for row in frame.collect()}
                for day in own:
                    for k, m in enumerate(members):
                        values[day, m] = found[day][f"m{k}"] if day in found else empty_value(m)
        return {(day, m): _outcome(values[day, m], m, day) for day, m in requests}


def _outcome(value: float | None, metric: Metric, day: dt.date) -> Ok | Err:
    if value is None:
        return fail(f"Null value encountered for symbol '{metric.name}' on date {day.isoformat()}")
    if math.isnan(value):
        return fail(f"NaN value encountered for symbol '{metric.name}' on date {day.isoformat()}")
    return Ok(value)


def available(dates: Iterable[dt.date], skipped: frozenset[dt.date]) -> float:
    """The share of the days that aren't skipped."""
    dates = list(dates)
    if not dates:
        raise ProbitasError("No dates")
    return reduce(lambda n, d: n + (d not in skipped), dates, 0) / len(dates)
