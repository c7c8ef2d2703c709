"""Aggregate metrics as factories of Spark aggregate columns.

A metric is one number for a set of rows.  Its column is a double; ``where`` restricts it to
the rows for which a condition holds, so metrics with different filters share one scan, where
that means the same as filtering before.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas.keys import ProbitasError, freeze

INFINITY = float("inf")
LENGTH_KINDS = ("string", "list", "map")


@dataclass(frozen=True)
class Kind:
    """How a kind of metric is computed.

    column: (metric, input) to an aggregate; ``input`` wraps a row-wise column so that rows
    outside a filter become null.  empty: the value over no rows; None is a failure.
    filterable: whether wrapping the input is the same as filtering the rows.  numeric: temporal
    input is refused.
    """

    name: str
    column: Callable[[Metric, Callable[[Column], Column]], Column]
    empty: float | None = None
    filterable: bool = True
    numeric: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Metric:
    """A kind with its arguments, and parameters that the source turns into row filters."""

    kind: str
    args: tuple = ()
    parameters: tuple = ()

    def with_parameters(self, parameters: dict[str, Any] | None) -> Metric:
        return Metric(self.kind, self.args, freeze(parameters or {}))

    @property
    def spec(self) -> Kind:
        try:
            return _KINDS[self.kind]
        except KeyError:
            raise ProbitasError(f"Unknown kind of metric: {self.kind}") from None

    @property
    def name(self) -> str:
        if self.kind == "custom_sql":
            return f"custom_sql({hashlib.md5(self.args[0].encode()).hexdigest()[:8]})"
        return f"{self.kind}({', '.join(_shown(a) for a in self.args)})"

    @property
    def inputs(self) -> tuple[str, ...]:
        """The column texts that the metric reads."""
        if self.kind in ("num_rows", "custom_sql"):
            return ()
        first = self.args[0]
        return first if isinstance(first, tuple) else (first,)

    def column(self, where: Column | None = None) -> Column:
        if where is not None and not self.spec.filterable:
            raise ProbitasError(f"{self.name} can't be filtered within an aggregation")
        return self.spec.column(self, (lambda c: c) if where is None else (lambda c: F.when(where, c))).cast("double")

    def row_value(self, where: Column | None = None) -> Column:
        """The number that a row has for the metric; null outside ``where``."""
        value = F.expr(self.args[0]).cast("double")
        return value if where is None else F.when(where, value)

    def validate(self, frame: DataFrame) -> None:
        """Refuse temporal input where a number is needed: engines disagree on what it would mean."""
        if not self.spec.numeric:
            return
        for text in self.inputs:
            kind = frame.select(F.expr(text)).schema[0].dataType
            if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
                raise ProbitasError(f"{self.name}: {text} is a {kind.simpleString()}, not a number")


def _shown(x: Any) -> str:
    return f"[{', '.join(map(_shown, x))}]" if isinstance(x, tuple) else str(x)


_KINDS: dict[str, Kind] = {}


def register(kind: Kind) -> Kind:
    """Add a kind of metric; names are unique."""
    if kind.name in _KINDS:
        raise ProbitasError(f"A kind of metric named {kind.name} exists")
    _KINDS[kind.name] = kind
    return kind


def kinds() -> tuple[str, ...]:
    return tuple(_KINDS)


def _input(m: Metric) -> Column:
    return F.expr(m.args[0])


def _double(m: Metric) -> Column:
    return _input(m).cast("double")


def _length(m: Metric) -> Column:
    return F.length(_input(m)) if m.args[1] == "string" else F.size(_input(m))


def _one_or_struct(m: Metric) -> Column:
    # count(distinct a, b) drops rows with a null part, a struct keeps them
    names = m.args[0]
    return F.expr(names[0]) if len(names) == 1 else F.struct(*(F.expr(n).alias(f"c{k}") for k, n in enumerate(names)))


def _is_value(m: Metric) -> Column:
    values = m.args[1] if isinstance(m.args[1], tuple) else (m.args[1],)
    return _input(m).isin(*(F.lit(v) for v in values))


def _first(m: Metric, w) -> Column:
    if len(m.args) > 1 and m.args[1] is not None:
        return F.min_by(_input(m), F.expr(m.args[1]))
    return F.first(_input(m))


def _age(m: Metric, w) -> Column:
    column, pick, now = m.args
    newest = (F.max if pick == "max" else F.min)(w(F.expr(column).cast("timestamp")))
    return (F.lit(int(now.timestamp() * 1_000_000)) - F.unix_micros(newest)) / 3.6e9


def _gaps(m: Metric, w) -> Column:
    column, unit, start, end = m.args
    period = lambda c: F.date_trunc(unit, c.cast("timestamp_ntz"))
    low, high = (period(F.lit(x)) for x in (start, end))
    value = period(F.expr(column))
    wanted = F.sequence(low, high, F.expr(f"interval 1 {unit}"))
    there = F.collect_set(w(F.when(value.between(low, high), value)))
    return F.size(F.array_except(wanted, there))


for _kind in (
    Kind("num_rows", lambda m, w: F.count(w(F.lit(1))), 0.0),
    Kind("average", lambda m, w: F.avg(w(_double(m))), numeric=True),
    Kind("minimum", lambda m, w: F.min(w(_input(m))), numeric=True),
    Kind("maximum", lambda m, w: F.max(w(_input(m))), numeric=True),
    Kind("sum", lambda m, w: F.sum(w(_double(m))), numeric=True),
    Kind("variance", lambda m, w: F.var_samp(w(_double(m))), numeric=True),
    Kind("first", _first, filterable=False, numeric=True),
    Kind("null_count", lambda m, w: F.count_if(w(_input(m).isNull())), 0.0),
    Kind("negative_count", lambda m, w: F.count_if(w(_input(m) < 0)), 0.0, numeric=True),
    Kind("unique_count", lambda m, w: F.count_distinct(w(_input(m))), 0.0, distinct=True),
    Kind("duplicate_count", lambda m, w: F.count(w(F.lit(1))) - F.count_distinct(w(_one_or_struct(m))), 0.0, distinct=True),
    Kind("count_values", lambda m, w: F.count_if(w(_is_value(m))), 0.0),
    Kind("min_length", lambda m, w: F.min(w(_length(m)))),
    Kind("max_length", lambda m, w: F.coalesce(F.max(w(_length(m))).cast("double"), F.lit(-INFINITY)), -INFINITY),
    Kind("custom_sql", lambda m, w: F.expr(m.args[0]), filterable=False),
    Kind("matching_count", lambda m, w: F.count_if(w(F.expr(m.args[0]).rlike(m.args[1]))), 0.0),
    Kind("folded_count", lambda m, w: F.count_if(w(F.lower(_input(m)).isin(*(F.lit(v.lower()) for v in m.args[1])))), 0.0),
    Kind("average_length", lambda m, w: F.avg(w(_length(m)))),
    Kind("percentile", lambda m, w: F.percentile(w(_double(m)), F.lit(m.args[1])), numeric=True),
    Kind("approximate_percentile", lambda m, w: F.percentile_approx(w(_double(m)), F.lit(m.args[1]), F.lit(10000)), numeric=True),
    Kind("approximate_unique_count", lambda m, w: F.approx_count_distinct(w(_input(m))), 0.0),
    Kind("age_hours", _age),
    Kind("gap_count", _gaps),
):
    register(_kind)


def empty_value(metric: Metric) -> float | None:
    """The value of a day without rows."""
    if metric.kind == "gap_count":
        _, unit, start, end = metric.args
        return float(len(list(_periods(unit, start, end))))
    return metric.spec.empty


def _truncated(unit: str, x: dt.datetime) -> dt.datetime:
    """The start of the period; weeks begin on Monday, as Spark's ``date_trunc`` has it."""
    x = x.replace(minute=0, second=0, microsecond=0)
    if unit == "hour":
        return x
    x = x.replace(hour=0)
    return x - dt.timedelta(days=x.weekday()) if unit == "week" else x.replace(day=1) if unit == "month" else x


def _periods(unit: str, start: dt.datetime, end: dt.datetime):
    at, end = _truncated(unit, start), _truncated(unit, end)
    while at <= end:
        yield at
        if unit == "month":
            at = (at.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        else:
            at += {"hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(days=7)}[unit]


def num_rows() -> Metric:
    return Metric("num_rows")


def average(column: str) -> Metric:
    return Metric("average", (column,))


def minimum(column: str) -> Metric:
    return Metric("minimum", (column,))


def maximum(column: str) -> Metric:
    return Metric("maximum", (column,))


def total(column: str) -> Metric:
    return Metric("sum", (column,))


def variance(column: str) -> Metric:
    return Metric("variance", (column,))


def first(column: str, order_by: str | None = None) -> Metric:
    """With ``order_by``, the value of the row with the smallest; else of any row."""
    return Metric("first", (column,) if order_by is None else (column, order_by))


def approximate_unique_count(column: str) -> Metric:
    """HyperLogLog++ with a relative deviation of 5 %."""
    return Metric("approximate_unique_count", (column,))


def null_count(column: str) -> Metric:
    return Metric("null_count", (column,))


def negative_count(column: str) -> Metric:
    return Metric("negative_count", (column,))


def unique_count(column: str) -> Metric:
    return Metric("unique_count", (column,))


def duplicate_count(columns: list[str]) -> Metric:
    if not columns:
        raise ValueError("duplicate_count needs at least one column")
    return Metric("duplicate_count", (tuple(sorted(columns)),))


def count_values(column: str, values: Any) -> Metric:
    if isinstance(values, list | tuple | set | frozenset):
        values = tuple(values)
        types = {type(v) for v in values}
        if not values or len(types) != 1 or not types <= {int, str}:
            raise ValueError("count_values takes a value, or a list of integers or of strings that isn't empty")
    elif not isinstance(values, int | str | bool):
        raise ValueError(f"count_values takes integers, strings and booleans, not {type(values).__name__}")
    return Metric("count_values", (column, values))


def _checked_length(kind: str, column: str, type_: str) -> Metric:
    if type_ not in LENGTH_KINDS:
        raise ValueError(f"Lengths are those of {', '.join(LENGTH_KINDS)}, not {type_!r}")
    return Metric(kind, (column, type_))


def min_length(column: str, type_: str = "string") -> Metric:
    return _checked_length("min_length", column, type_)


def max_length(column: str, type_: str = "string") -> Metric:
    return _checked_length("max_length", column, type_)


def average_length(column: str, type_: str = "string") -> Metric:
    return _checked_length("average_length", column, type_)


def custom_sql(expression: str) -> Metric:
    """Any aggregate expression of Spark SQL."""
    return Metric("custom_sql", (expression,))


def matching_count(column: str, pattern: str, flags: tuple[str, ...] = ()) -> Metric:
    """Rows whose value holds a match of a Java regular expression."""
    marks = "".join({"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s", "VERBOSE": "x"}[f] for f in flags)
    return Metric("matching_count", (column, f"(?{marks}){pattern}" if marks else pattern))


def percentile(column: str, p: float, exact: bool = True) -> Metric:
    if not 0 <= p <= 1:
        raise ValueError("A percentile lies between 0 and 1")
    return Metric("percentile" if exact else "approximate_percentile", (column, float(p)))


def age_hours(column: str, now: dt.datetime, pick: str = "max") -> Metric:
    """Hours from the newest (max) or oldest (min) timestamp to ``now``."""
    return Metric("age_hours", (column, pick, now if now.tzinfo else now.replace(tzinfo=dt.UTC)))


def gap_count(column: str, unit: str, start: dt.datetime, end: dt.datetime) -> Metric:
    """Periods (hour, day, week, month) from start to end without a row."""
    return Metric("gap_count", (column, unit, start, end))
