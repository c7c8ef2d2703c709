"""Mergeable states: what of a metric is kept so that parts of the rows can be added later.

A state is a set of named aggregate columns, a way to merge two, and a way to read the value.
Distinct counts and percentiles can't be merged.  The first of all rows without an order is that
of the first part which has one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.keys import ProbitasError

from .metrics import Metric

Parts = dict[str, float | None]
Part = Callable[[str], Column]


@dataclass(frozen=True)
class State:
    columns: Callable[[Metric], dict[str, Column]]
    merge: Callable[[Parts, Parts], Parts]
    value: Callable[[Parts], float | None]
    identity: Parts
    #: The merge as aggregates over rows of parts, for tables of states: the metric and the column of each part.
    combine: Callable[[Metric, Part], dict[str, Column]]
    read: Callable[[Part], Column] = lambda part: part("value")


def _plus(a: Parts, b: Parts) -> Parts:
    return {k: (a[k] or 0.0) + (b[k] or 0.0) for k in a}


def _pick(choose: Callable[[float, float], float]) -> Callable[[Parts, Parts], Parts]:
    def merge(a: Parts, b: Parts) -> Parts:
        x, y = a["value"], b["value"]
        return {"value": y if x is None else x if y is None else choose(x, y)}

    return merge


def _average(a: Parts, b: Parts) -> Parts:
    n = a["n"] + b["n"]
    if not n:
        return {"n": 0.0, "mean": None}
    return {"n": n, "mean": ((a["mean"] or 0.0) * a["n"] + (b["mean"] or 0.0) * b["n"]) / n}


def _variance(a: Parts, b: Parts) -> Parts:
    """Chan, Golub and LeVeque's update of the sum of squared deviations."""
    if not a["n"] or not b["n"]:
        return dict(a if a["n"] else b)
    n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
    return {"n": n, "mean": a["mean"] + delta * b["n"] / n, "m2": a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n}


def _variance_columns(m: Metric) -> dict[str, Column]:
    x = F.expr(m.args[0]).cast("double")
    n = F.count(x).cast("double")
    return {"n": n, "mean": F.avg(x), "m2": F.coalesce(F.var_pop(x) * n, F.lit(0.0))}


def _common_mean(part: Part) -> Column:
    return F.sum(part("n") * F.coalesce(part("mean"), F.lit(0.0))) / F.nullif(F.sum(part("n")), F.lit(0.0))


def _variance_combine(m: Metric, part: Part) -> dict[str, Column]:
    """Every part's sum of squared deviations, moved to the mean of all; ``common``, which ``combined`` adds, has that mean."""
    away = F.coalesce(part("mean") - part("common"), F.lit(0.0))
    return {"n": F.sum(part("n")), "mean": F.max(part("common")), "m2": F.sum(part("m2") + part("n") * away * away)}


def _first_columns(m: Metric) -> dict[str, Column]:
    ordered = len(m.args) > 1
    x = F.expr(m.args[0]).cast("double")
    return {"value": m.column() if ordered else F.first(x, ignorenulls=True), "order": F.min(F.expr(m.args[1])) if ordered else F.max(F.lit(None).cast("double"))}


def _first(a: Parts, b: Parts) -> Parts:
    if a["order"] is None or b["order"] is None:
        ordered = next((p for p in (a, b) if p["order"] is not None), None)
        return dict(ordered or (b if a["value"] is None else a))
    return dict(b if b["order"] < a["order"] else a)


def _first_combine(m: Metric, part: Part) -> dict[str, Column]:
    if len(m.args) > 1:
        return {"value": F.min_by(part("value"), part("order")), "order": F.min(part("order"))}
    return {"value": F.first(part("value"), ignorenulls=True), "order": F.max(part("order"))}


def _own(m: Metric) -> dict[str, Column]:
    return {"value": m.column()}


def _value_by(aggregate: Callable[[Column], Column]) -> Callable[[Metric, Part], dict[str, Column]]:
    return lambda m, part: {"value": aggregate(part("value"))}


_value = lambda p: p["value"]
_ADDITIVE = State(_own, _plus, _value, {"value": 0.0}, _value_by(F.sum))
_SUM = State(_own, lambda a, b: {"value": None if a["value"] is None and b["value"] is None else (a["value"] or 0.0) + (b["value"] or 0.0)}, _value, {"value": None}, _value_by(F.sum))
_MINIMUM = State(_own, _pick(min), _value, {"value": None}, _value_by(F.min))
_MAXIMUM = State(_own, _pick(max), _value, {"value": None}, _value_by(F.max))
_STATES = {
    **dict.fromkeys(("num_rows", "null_count", "negative_count", "count_values", "matching_count", "folded_count"), _ADDITIVE),
    "sum": _SUM,
    **dict.fromkeys(("minimum", "min_length"), _MINIMUM),
    **dict.fromkeys(("maximum", "max_length"), _MAXIMUM),
    "first": State(_first_columns, _first, _value, {"value": None, "order": None}, _first_combine),
    "average": State(
        lambda m: {"n": F.count(F.expr(m.args[0])).cast("double"), "mean": m.column()},
        _average,
        lambda p: p["mean"],
        {"n": 0.0, "mean": None},
        lambda m, part: {"n": F.sum(part("n")), "mean": _common_mean(part)},
        lambda part: part("mean"),
    ),
    "variance": State(
        _variance_columns,
        _variance,
        lambda p: p["m2"] / (p["n"] - 1) if p["n"] > 1 else None,
        {"n": 0.0, "mean": None, "m2": 0.0},
        _variance_combine,
        lambda part: F.when(part("n") > 1, part("m2") / (part("n") - 1)),
    ),
}


def state_columns(metrics: dict[str, Metric]) -> list[Column]:
    """The aggregates that make a row of a table of states, named by metric and part."""
    return [c.alias(f"{name}_{part}") for name, m in metrics.items() for part, c in state_of(m).columns(m).items()]


def combined(table: DataFrame, keys: list[str], metrics: dict[str, Metric]) -> DataFrame:
    """(keys, a column for each metric, by its name) from a table of states of disjoint parts.

    One aggregation; with variances, one before it for the means of all, so that squares of
    large values aren't subtracted from each other.  Null keys are keys like others.
    """
    part = lambda name: lambda p: F.col(f"`{name}_{p}`")
    if moments := [n for n, m in metrics.items() if m.kind == "variance"]:
        means = table.groupBy(*(F.col(k).alias(f"key_{k}") for k in keys)).agg(*(_common_mean(part(n)).alias(f"{n}_common") for n in moments))
        table = table.join(means, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys), F.lit(True)))
    merged_ = table.groupBy(*keys).agg(*(c.alias(f"{n}_{p}") for n, m in metrics.items() for p, c in state_of(m).combine(m, part(n)).items()))
    return merged_.select(*keys, *(state_of(m).read(part(n)).alias(n) for n, m in metrics.items()))


def mergeable(metric: Metric) -> bool:
    return metric.kind in _STATES


def state_of(metric: Metric) -> State:
    if not mergeable(metric):
        raise ProbitasError(f"Cannot merge {metric.kind}: its parts don't determine the whole")
    return _STATES[metric.kind]


def beside(metric: Metric) -> list[Metric]:
    """The metrics that, with its own value, make the state of ``metric``."""
    if metric.kind not in ("average", "variance"):
        return []
    counts = [Metric("num_rows", (), metric.parameters), Metric("null_count", metric.args, metric.parameters)]
    return counts if metric.kind == "average" else [*counts, Metric("average", metric.args, metric.parameters)]


def stored(metric: Metric, value: Callable[[Metric], float | None]) -> Parts | None:
    """The state of ``metric`` from values of it and of the metrics beside it; None if it has none, or not all of it is known."""
    own = value(metric)
    if not mergeable(metric) or own is None or metric.kind == "first" and len(metric.args) > 1:
        return None
    if metric.kind == "first":
        return {"value": own, "order": None}
    if metric.kind not in ("average", "variance"):
        return {"value": own}
    rows, nulls, *mean = (value(m) for m in beside(metric))
    if rows is None or nulls is None or None in mean:
        return None
    n = rows - nulls
    return {"n": n, "mean": own} if metric.kind == "average" else {"n": n, "mean": mean[0], "m2": own * (n - 1)}


def merged(metric: Metric, parts: list[Parts]) -> Parts:
    """The state of all rows from those of disjoint parts."""
    state = state_of(metric)
    out = dict(state.identity)
    for part in parts:
        out = state.merge(out, part)
    return out


def finite(value: float | None) -> bool:
    return value is not None and math.isfinite(value)
