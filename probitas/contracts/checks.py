"""The check types of contracts, as expressions over metrics with validators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from probitas.functions.expr import Expr, sqrt
from probitas.keys import SEVERITIES, valid_tags
from probitas.operators import metrics as M

from .types import ContractValidationError

FORMATS = {
    "email": r"^[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[1-9]\d{1,14}$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "url": r"^https?://[^\s/$.?#]\S*$",
    "ipv4": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "ipv6": "^" + ":".join([r"[\da-fA-F]{1,4}"] * 8) + "$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
}
FLAGS = tuple("IGNORECASE MULTILINE DOTALL VERBOSE".split())
UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}
TABLE_TYPES = ("num_rows", "duplicates", "freshness", "completeness")
COLUMN_TYPES = (
    "missing duplicates whitelist blacklist pattern min_length max_length avg_length cardinality min max mean sum count variance stddev percentile".split()
)
_COMMON = {"type", "name", "severity", "tags", "description", "min", "max", "between", "not_between", "equals", "tolerance"}
_OWN = {
    "duplicates": {"return", "columns"},
    "missing": {"return"},
    "whitelist": {"return", "values", "case_sensitive"},
    "blacklist": {"return", "values", "case_sensitive"},
    "pattern": {"return", "pattern", "format", "flags"},
    "min_length": {"return"},
    "max_length": {"return"},
    "percentile": {"percentile", "approximate"},
    "cardinality": {"approximate"},
    "freshness": {"max_age_hours", "timestamp_column", "aggregation"},
    "completeness": {"partition_column", "granularity", "lookback_days", "allow_future_gaps", "max_gap_count"},
}


@dataclass(frozen=True)
class Validator:
    """One of min, max, between, not_between, equals, with its bounds."""

    kind: str
    bounds: tuple[float, ...]
    tolerance: float = 1e-9

    @property
    def text(self) -> str:
        shown = ", ".join(str(float(b)) for b in self.bounds)
        return {"min": f"min >= {shown}", "max": f"max <= {shown}", "equals": f"equals = {shown}"}.get(self.kind, f"{self.kind} [{shown}]")

    def apply(self, ready: Any) -> None:
        method = {"min": "is_geq", "max": "is_leq", "between": "is_between", "not_between": "is_not_between", "equals": "is_eq"}[self.kind]
        getattr(ready, method)(*self.bounds, tol=self.tolerance)


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def parse_validators(data: dict[str, Any], where: str) -> tuple[Validator, ...]:
    tolerance = data.get("tolerance", 1e-9)
    if not _number(tolerance) or tolerance < 0:
        raise ContractValidationError(f"{where}: tolerance must be a number of at least 0")
    out = []
    for kind in "min max between not_between equals".split():
        if kind not in data:
            continue
        value = data[kind]
        if kind in ("between", "not_between"):
            if not isinstance(value, list) or len(value) != 2 or not all(map(_number, value)):
                raise ContractValidationError(f"{where}: {kind} is a list of two numbers")
            if value[0] > value[1]:
                raise ContractValidationError(f"{where}: {kind} has its lower bound above the upper")
            out.append(Validator(kind, tuple(value), tolerance))
        elif not _number(value):
            raise ContractValidationError(f"{where}: {kind} must be a number")
        else:
            out.append(Validator(kind, (value,), tolerance))
    low, high = (next((v.bounds[0] for v in out if v.kind == k), None) for k in ("min", "max"))
    if low is not None and high is not None and low > high:
        raise ContractValidationError(f"{where}: min is above max")
    return tuple(out)


@dataclass(frozen=True)
class ContractCheck:
    """A check of a contract. column: None for a check of the table. length: kind of length of the column."""

    type: str
    name: str
    column: str | None = None
    options: tuple[tuple[str, Any], ...] = ()
    validators: tuple[Validator, ...] = ()
    severity: str = "P1"
    tags: frozenset[str] = frozenset()
    length: str = "string"

    def option(self, key: str, default: Any = None) -> Any:
        return dict(self.options).get(key, default)

    def expression(self, mp: Any, now: dt.datetime, day: dt.date) -> Expr:
        """What the check measures."""
        c = self.column
        metric = lambda m: mp.metric(m)
        share = lambda e: e / mp.num_rows() if self.option("return", "count") == "pct" else e
        match self.type:
            case "num_rows":
                return mp.num_rows()
            case "duplicates":
                return share(mp.duplicate_count(list(self.option("columns") or [c])))
            case "freshness":
                return metric(M.age_hours(self.option("timestamp_column"), now, self.option("aggregation", "max")))
            case "completeness":
                unit = UNITS[self.option("granularity", "daily")]
                end = dt.datetime.combine(day, dt.time(23) if unit == "hour" else dt.time())
                start = dt.datetime.combine(day - dt.timedelta(days=self.option("lookback_days") - 1), dt.time())
                if self.option("allow_future_gaps", True):
                    end = min(end, max(start, now.replace(tzinfo=None)))
                return metric(M.gap_count(self.option("partition_column"), unit, start, end))
            case "missing":
                return share(mp.null_count(c))
            case "whitelist" | "blacklist":
                values = list(self.option("values"))
                if self.option("case_sensitive", True) or not isinstance(values[0], str):
                    found = mp.count_values(c, values)
                else:
                    found = metric(M.Metric("folded_count", (c, tuple(values))))
                return share(found if self.type == "whitelist" else mp.num_rows() - found)
            case "pattern":
                return share(metric(M.matching_count(c, self.option("pattern") or FORMATS[self.option("format")], tuple(self.option("flags") or ()))))
            case "min_length":
                return mp.min_length(c, self.length)
            case "max_length":
                return mp.max_length(c, self.length)
            case "avg_length":
                return metric(M.average_length(c, self.length))
            case "cardinality":
                return metric(M.approximate_unique_count(c)) if self.option("approximate") else mp.unique_count(c)
            case "min":
                return mp.minimum(c)
            case "max":
                return mp.maximum(c)
            case "mean":
                return mp.average(c)
            case "sum":
                return mp.sum(c)
            case "count":
                return mp.num_rows() - mp.null_count(c)
            case "variance":
                return mp.variance(c)
            case "stddev":
                return sqrt(mp.variance(c))
            case "percentile":
                return metric(M.percentile(c, self.option("percentile"), exact=not self.option("approximate")))
        raise ContractValidationError(f"Unknown type of check: {self.type}")

    @property
    def limits(self) -> tuple[Validator, ...]:
        """The validators, with those that the type's own options stand for."""
        out = self.validators
        if self.type == "freshness" and self.option("max_age_hours") is not None:
            out += (Validator("max", (self.option("max_age_hours"),)),)
        if self.type == "completeness" and self.option("max_gap_count") is not None:
            out += (Validator("max", (self.option("max_gap_count"),)),)
        return out

    def add_to(self, mp: Any, ctx: Any, now: dt.datetime, day: dt.date) -> None:
        """Assert each validator under a name of its own; without any, only collect the value."""
        expression = self.expression(mp, now, day)
        if not self.limits:
            ctx.assert_that(expression).config(name=self.name, severity=self.severity, tags=self.tags).noop()
        for v in self.limits:
            v.apply(ctx.assert_that(expression).config(name=f"{self.name} [{v.text}]", severity=self.severity, tags=self.tags))


def parse_check(data: Any, column: str | None, where: str, length: str = "string") -> ContractCheck:
    if not isinstance(data, dict) or "type" not in data:
        raise ContractValidationError(f"{where}: a check is a mapping with a type")
    type_ = data["type"]
    if type_ not in (TABLE_TYPES if column is None else COLUMN_TYPES):
        raise ContractValidationError(f"{where}: unknown type of check {type_!r}")
    name = data.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ContractValidationError(f"{where}: check {type_} has no name")
    where = f"{where}, check {name!r}"
    own = _OWN.get(type_, set())
    if column is not None and type_ == "duplicates":
        own = own - {"columns"}
    if unknown := sorted(set(data) - _COMMON - own):
        raise ContractValidationError(f"{where}: unknown field(s) {', '.join(unknown)}")
    severity = data.get("severity", "P1")
    if severity not in SEVERITIES:
        raise ContractValidationError(f"{where}: {severity!r} is no severity")
    options = {k: data[k] for k in own if k in data}
    _check_options(type_, column, options, where)
    try:
        tags = valid_tags(data.get("tags"))
    except ValueError as error:
        raise ContractValidationError(f"{where}: {error}") from None
    frozen = tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in sorted(options.items()))
    return ContractCheck(type_, name.strip(), column, frozen, parse_validators(data, where), severity, tags, length)


def _check_options(type_: str, column: str | None, o: dict[str, Any], where: str) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ContractValidationError(f"{where}: {what}")

    need(o.get("return", "count") in ("count", "pct"), "return is count or pct")
    if type_ == "duplicates" and column is None:
        need(isinstance(o.get("columns"), list) and bool(o["columns"]), "duplicates of a table need columns")
    if type_ in ("whitelist", "blacklist"):
        values = o.get("values")
        need(isinstance(values, list) and bool(values), f"{type_} needs values")
        need(len({type(v) for v in values}) == 1 and isinstance(values[0], str | int) and not isinstance(values[0], bool), "values are all strings or all integers")
    if type_ == "pattern":
        need(("pattern" in o) != ("format" in o), "pattern needs exactly one of pattern and format")
        need("format" not in o or o["format"] in FORMATS, f"unknown format {o.get('format')!r}")
        need(all(f in FLAGS for f in o.get("flags") or ()), f"flags are among {', '.join(FLAGS)}")
    need(isinstance(o.get("approximate", False), bool), "approximate is true or false")
    if type_ == "percentile":
        need(_number(o.get("percentile")) and 0 <= o["percentile"] <= 1, "percentile is a number from 0 to 1")
    if type_ == "freshness":
        need(_number(o.get("max_age_hours")) and o["max_age_hours"] > 0, "max_age_hours is a number above 0")
        need(isinstance(o.get("timestamp_column"), str), "freshness needs a timestamp_column")
        need(o.get("aggregation", "max") in ("max", "min"), "aggregation is max or min")
    if type_ == "completeness":
        need(isinstance(o.get("partition_column"), str), "completeness needs a partition_column")
        need(o.get("granularity", "daily") in UNITS, f"granularity is one of {', '.join(UNITS)}")
        days = o.get("lookback_days")
        need(isinstance(days, int) and not isinstance(days, bool) and days >= 1, "lookback_days is an integer of at least 1")
        need(_number(o.get("max_gap_count", 0)) and o.get("max_gap_count", 0) >= 0, "max_gap_count is at least 0")
