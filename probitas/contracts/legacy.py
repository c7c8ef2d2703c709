"""YAML contracts: columns with types and checks, table checks, and an optional service level."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from probitas.plans.suite import check
from probitas.sources.frame import FrameSource

from .checks import ContractCheck, parse_check
from .types import ContractValidationError, ContractWarning, SchemaValidationError, check_schema, length_kind, parse_type

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = (
    {},
    {},
    {},
    {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    {d: k for k, d in enumerate("sun mon tue wed thu fri sat".split())},
)


def valid_cron(schedule: str) -> list[str]:
    """The five fields of a cron expression; raises if it isn't one."""
    fields = schedule.split() if isinstance(schedule, str) else []
    if len(fields) != 5:
        raise ContractValidationError(f"Schedule {schedule!r} doesn't have five fields")
    for text, (low, high), names in zip(fields, _RANGES, _NAMES, strict=True):
        for part in text.split(","):
            body, slash, step = part.partition("/")
            if slash and not (step.isdigit() and int(step) > 0):
                raise ContractValidationError(f"Schedule {schedule!r}: bad step in {text!r}")
            if body == "*":
                continue
            ends = [names.get(e.lower(), int(e) if e.isdigit() else None) for e in body.split("-")]
            if len(ends) > 2 or any(e is None or not low <= e <= high for e in ends) or (len(ends) == 2 and ends[0] > ends[1]):
                raise ContractValidationError(f"Schedule {schedule!r}: bad field {text!r}")
    return fields


def period_hours(schedule: str) -> float:
    """The hours between two runs of a regular schedule."""
    minute, hour, day, month, weekday = valid_cron(schedule)
    if not minute.isdigit() or month != "*":
        raise ContractValidationError(f"Schedule {schedule!r} has no period that can be told")
    if (hour, day, weekday) == ("*", "*", "*"):
        return 1
    if hour.startswith("*/") and (day, weekday) == ("*", "*"):
        return float(hour[2:])
    if hour.isdigit():
        if day == "*" and weekday in ("*", "1-5", "mon-fri", "MON-FRI"):
            return 24
        if day == "*" and (weekday.isdigit() or weekday.lower() in _NAMES[4]):
            return 168
        if day.isdigit() and weekday == "*":
            return 720
    raise ContractValidationError(f"Schedule {schedule!r} has no period that can be told")


@dataclass(frozen=True)
class ServiceLevel:
    schedule: str
    lag_hours: float

    def __post_init__(self) -> None:
        fields = valid_cron(self.schedule)
        if isinstance(self.lag_hours, bool) or not isinstance(self.lag_hours, int | float) or self.lag_hours < 0:
            raise ContractValidationError("lag_hours is a number of at least 0")
        if self.lag_hours > 168 and fields[2] == "*" and fields[4] == "*":
            warnings.warn(f"A lag of {self.lag_hours} hours is more than a week for schedule {self.schedule!r}", ContractWarning, stacklevel=3)

    def max_age_hours(self, partitioned: bool) -> float:
        return self.lag_hours + 1 + (period_hours(self.schedule) if partitioned else 0)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: Any
    nullable: bool = True
    description: str = ""
    checks: tuple[ContractCheck, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Contract:
    dataset: str
    name: str
    version: str
    owner: str
    description: str
    columns: tuple[ColumnSpec, ...]
    checks: tuple[ContractCheck, ...] = ()
    sla: ServiceLevel | None = None
    tags: tuple[str, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if doubled := sorted({n for n in names if names.count(n) > 1}):
            raise ContractValidationError(f"Column(s) declared twice: {', '.join(doubled)}")
        for c in self.checks:
            used = [*(c.option("columns") or ()), c.option("timestamp_column"), c.option("partition_column")]
            if unknown := [u for u in used if u is not None and u not in names]:
                raise ContractValidationError(f"Check {c.name!r} uses undeclared column(s) {', '.join(unknown)}")
        if unknown := [p for p in self.partitioned_by if p not in names]:
            raise ContractValidationError(f"partitioned_by has undeclared column(s) {', '.join(unknown)}")
        if self.sla and not self.timestamp_column:
            raise ContractValidationError("A service level of a table that isn't partitioned needs metadata.timestamp_column")
        if self.sla and self.timestamp_column not in names:
            raise ContractValidationError(f"timestamp_column {self.timestamp_column!r} isn't declared")

    @property
    def partitioned_by(self) -> tuple[str, ...]:
        value = self.metadata.get("partitioned_by") or ()
        return (value,) if isinstance(value, str) else tuple(value)

    @property
    def timestamp_column(self) -> str | None:
        return self.partitioned_by[0] if self.partitioned_by else self.metadata.get("timestamp_column")

    @classmethod
    def from_yaml(cls, path: str | Path) -> Contract:
        path = Path(path)
        if not path.exists():
            raise ContractValidationError(f"No contract at {path}")
        return cls.parse(path.read_text())

    @classmethod
    def parse(cls, text: str) -> Contract:
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ContractValidationError(f"No valid YAML: {error}") from None
        if not isinstance(data, dict):
            raise ContractValidationError("A contract is a mapping")
        needed = "name version description owner dataset columns".split()
        for key in needed:
            if not data.get(key):
                raise ContractValidationError(f"The contract has no {key}")
        known = {*needed, "checks", "sla", "tags", "metadata"}
        if unknown := sorted(set(data) - known):
            raise ContractValidationError(f"Unknown field(s) {', '.join(unknown)}")
        if not isinstance(data["columns"], list):
            raise ContractValidationError("columns is a list")
        sla = data.get("sla")
        if sla is not None and (not isinstance(sla, dict) or set(sla) != {"schedule", "lag_hours"}):
            raise ContractValidationError("sla has schedule and lag_hours")
        return cls(
            name=str(data["name"]),
            version=str(data["version"]),
            description=str(data["description"]),
            owner=str(data["owner"]),
            dataset=str(data["dataset"]),
            columns=tuple(_column(c) for c in data["columns"]),
            checks=tuple(parse_check(c, None, "Table") for c in data.get("checks") or ()),
            sla=ServiceLevel(**sla) if sla else None,
            tags=tuple(data.get("tags") or ()),
            metadata=data.get("metadata") or {},
        )

    def check_schema(self, schema: T.StructType) -> None:
        check_schema(schema, {c.name: (c.type, c.nullable) for c in self.columns})

    def all_checks(self) -> list[ContractCheck]:
        """Table checks, column checks, that of the service level, and null checks of columns declared not nullable."""
        out = [*self.checks, *(k for c in self.columns for k in c.checks)]
        if self.sla:
            hours = self.sla.max_age_hours(bool(self.partitioned_by))
            out.append(ContractCheck("freshness", "SLA: Freshness check", None, (("max_age_hours", hours), ("timestamp_column", self.timestamp_column)), severity="P0"))
        return out

    def to_checks(self, source: FrameSource | None = None, now: dt.datetime | None = None, day: dt.date | None = None) -> list[Callable]:
        """One check with all assertions.

        source: if given, its schema is checked when the suite is built.  now: what freshness is
        measured against; the present by default.  day: the last day of completeness; today by
        default.
        """
        moment = now or dt.datetime.now(dt.UTC)
        last = day or moment.date()

        @check(name=self.name, datasets=[self.dataset])
        def contract(mp: Any, ctx: Any) -> None:
            if source is not None:
                self.check_schema(source.schema)
            names: dict[str, int] = {}
            for c in self.all_checks():
                names[c.name] = names.get(c.name, 0) + 1
                if names[c.name] > 1:  # columns may name their checks alike
                    c = ContractCheck(c.type, f"{c.column or 'table'}: {c.name}", c.column, c.options, c.validators, c.severity, c.tags, c.length)
                c.add_to(mp, ctx, moment, last)

        return [contract]


def _column(data: Any) -> ColumnSpec:
    if not isinstance(data, dict) or not data.get("name"):
        raise ContractValidationError("A column is a mapping with a name")
    where = f"Column {data['name']!r}"
    if unknown := sorted(set(data) - {"name", "type", "nullable", "description", "metadata", "checks"}):
        raise ContractValidationError(f"{where}: unknown field(s) {', '.join(unknown)}")
    if "type" not in data:
        raise ContractValidationError(f"{where} has no type")
    type_ = parse_type(data["type"], where)
    checks = tuple(parse_check(c, data["name"], where, length_kind(type_)) for c in data.get("checks") or ())
    return ColumnSpec(data["name"], type_, bool(data.get("nullable", True)), data.get("description", ""), checks, data.get("metadata") or {})


__all__ = ["ColumnSpec", "Contract", "ContractValidationError", "SchemaValidationError", "ServiceLevel", "period_hours", "valid_cron"]
